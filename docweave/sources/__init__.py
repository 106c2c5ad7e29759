"""Readers and writers: documents of many formats, knowledge graphs, exports."""
