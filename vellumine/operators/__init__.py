"""Operators over tables of spans, rectangles, roles and images, and the decoder as an operator."""
