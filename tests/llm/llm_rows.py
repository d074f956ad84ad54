"""Rows that the tests share."""

SMALL = "/root/testdata/sf0.001"

LONG = "word " * 30_000

#: Nulls, empty, white space only, control characters, ties, repeated rows, very long.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "One"), (5, "One"), (None, "null id"), (None, None),
    (6, "a\x1cb \x85 c d e"), (7, "  two  spaces \n\n and\r\nlines\n"), (8, LONG), (9, LONG + "end"),
    (10, "日本語テキスト 한국어 العربية 🎉🎉 é"), (11, "<|endoftext|> <|im_start|> it's we'll '" ), (12, "\\<| \\\\ %s {} $1"),
]
