"""Reading and writing the tables the jobs work on."""
