"""Column functions: text, dates, arrays, vectors and rules. None of them is a Python UDF but for Unicode normalization."""
