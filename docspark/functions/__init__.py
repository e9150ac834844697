"""Column functions: text rules, headings and box geometry."""
