"""Jobs that run on their own: a function that takes a session, a config file, a command line."""
