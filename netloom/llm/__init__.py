"""Training-data operators: text, token, page, audio and mixing operators over document tables.

Nothing outside this subpackage imports it.
"""
