"""Log sources: lines with exact positions, format detection, parsers to event rows, ingestion."""
