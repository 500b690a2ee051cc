"""Named queries over the tables of a data folder, each with its SQL for comparison where SQL can say it."""
