"""The driver tables seen as fleet data, the registered queries, and their SQL twins."""
