"""Table, file and stream sources; parsers; layout reconstruction; previews."""
