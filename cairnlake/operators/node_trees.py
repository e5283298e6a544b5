"""Messages along one branch of an export whose turns are nodes that name parent and children.

The walk follows references from node to node, so a file is read in one Arrow step with
its nodes in a hash table: the cost grows with the size of the file. Files of other
shapes reach the step as NULL.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDES = ("user", "assistant")
BRANCH = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def _spoken(node: dict[str, Any]) -> dict[str, str] | None:
    message = node.get("message")
    author = message.get("author") if isinstance(message, dict) else None
    role = author.get("role") if isinstance(author, dict) else None
    content = message.get("content") if isinstance(message, dict) else None
    parts = content.get("parts") if isinstance(content, dict) else None
    said = [part for part in parts if isinstance(part, str) and part.strip()] if isinstance(parts, list) else []
    if role not in SIDES or not said:
        return None
    # Half of a surrogate pair has no place in a column of strings.
    return {"role": role, "text": " ".join(said).encode("utf-8", "replace").decode()}


def branch_of(text: str) -> list[dict[str, str]] | None:
    """Messages of the first branch of one file; None when it has no ``mapping`` or no root.

    The branch starts at the first node without parent and message, else at the first
    without parent, and goes on to the first child. It ends at a node that is missing, no
    object, or on the branch already.
    """
    try:
        document = json.loads(text)
    except (ValueError, RecursionError):
        return None
    mapping = document.get("mapping") if isinstance(document, dict) else None
    if not isinstance(mapping, dict):
        return None
    nodes = {key: node for key, node in mapping.items() if isinstance(node, dict)}
    roots = [key for key, node in nodes.items() if node.get("parent") is None]
    if not roots:
        return None
    here: Any = next((key for key in roots if nodes[key].get("message") is None), roots[0])
    branch: dict[str, dict[str, Any]] = {}
    while isinstance(here, str) and here in nodes and here not in branch:
        branch[here] = nodes[here]
        children = nodes[here].get("children")
        here = children[0] if isinstance(children, list) and children else None
    spoken = [_spoken(node) for node in branch.values()]
    return [message for message in spoken if message is not None]


@F.pandas_udf(BRANCH)
def _branches(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: None if text is None else branch_of(text))


def branch_messages(content: Column) -> Column:
    """``array<struct<role, text>>`` of a file with a ``mapping`` of nodes, NULL for any other."""
    # An escape may spell the name, so such files are looked at too.
    named = F.contains(content, F.lit("mapping")) | F.contains(content, F.lit("\\u"))
    return _branches(F.when(F.startswith(F.ltrim(content, F.lit(" \t\r\n")), F.lit("{")) & named, content))
