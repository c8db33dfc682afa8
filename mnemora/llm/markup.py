"""Lines and blocks of Markdown and plain text, shared by splitting and sentences."""

from __future__ import annotations

from mnemora.functions.text import speakers

#: Spaces within a line.
GAP = "[ \\t\\u00a0\\u3000\\u200b]"
TURN = "(?:\\*\\*)?(?:" + "|".join(speakers()) + ")(?: \\d{1,3})?(?:\\*\\*)?" + "[ \\u00a0]?[:：]"
ITEM = "(?:[-*+•]|\\d{1,4}[.)])[ \\t\\u00a0]"
#: An item that may follow a paragraph's line directly.
FIRST_ITEM = "(?:[-*+•]|1[.)])[ \\t\\u00a0]"
RULE = "(?:(?:-[ \\t]*+){3,}+|(?:\\*[ \\t]*+){3,}+|(?:_[ \\t]*+){3,}+)"
