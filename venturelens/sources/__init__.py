"""Sources, sinks and input bindings."""
