"""Training-data operators: text in, decisions and digests out.

Each module holds one operator with a general interface; ``registry`` derives
the driver's thin queries from them.
"""
