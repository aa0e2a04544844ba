"""The same queries over streams of snapshots, and windows over the event log."""
