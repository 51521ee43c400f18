"""The commands, the command line and the driver queries."""
