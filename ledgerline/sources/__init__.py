"""Statement files and extracted statement text, turned into typed rows.

Every layout job partitions its input once, by ``file_id``; windows, per-file facts and the joins
back to rows all reuse that one shuffle. A file is the largest unit handled in one task.
"""
