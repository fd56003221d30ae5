"""Jobs: what is run from a command line or a scheduler, each with a config file of its own beside it."""
