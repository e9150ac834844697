"""Operators over tables of books, pages, paragraphs, words and detections."""
