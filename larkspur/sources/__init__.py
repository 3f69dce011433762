"""Reading and writing: COPY text and CSV, series, values."""
