"""Live tailing of log files by Structured Streaming."""
