"""Training-data operators. Each module holds one operator, its query and, where SQL can state the result, its SQL."""
