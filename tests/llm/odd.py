"""Rows that every operator must take."""

LONG = "lorem ipsum dolor sit amet " * 40_000
#: Nulls, empty and blank texts, ties, repeated rows, a null id, a very long text.
ODD = [(1, None), (2, ""), (3, " \n "), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, "a b c d e f g"), (None, "x y"), (None, "x y"), (None, None), (6, LONG), (7, "é 漢字 \U0001f600 K")]
CLASH = {k: 1 for k in ("size", "copies", "n", "value", "node", "blob", "spans", "features", "score", "_h", "_tie", "shard", "template", "label", "arc", "offset")}
