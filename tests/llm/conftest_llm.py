"""Rows that every operator is tried on."""

#: Texts of every odd kind: null, empty, white space, no letter, one word, repeated rows, other scripts, very long.
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "12 34 !!"), (5, "one"), (5, "one"), (6, "Ünï çödé ß ǅ ﬁ"), (7, "漢字 かな 한국어"), (8, "a\U0001f600b \U0001f1e6"),
    (None, "no id at all here"), (9, "x" * 50_000), (10, "word " * 20_000), (11, "a\r\nb\r\n\r\nc"), (12, "tail  "), (13, "   odd spaces \x1c "),
]
