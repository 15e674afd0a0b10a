"""Reading and writing: CSV files, message tables, the readings table, key-value dumps."""
