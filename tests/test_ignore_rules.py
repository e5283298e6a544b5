"""Ignore rules judged in the row, against a walk over every folder and rule in plain Python."""

from __future__ import annotations

import random
import re

from cairnlake.sources import files

LINES = ["*.log", "!keep.log", "build/", "/a", "a/b", "!a/b/", "**/c", "b", "# note", "", "!*.md", "x?.txt", "\\#odd", "  d/ ", "/a/**/k.log"]


def _pattern(body: str, rooted: bool) -> re.Pattern:
    steps = []
    for part in body.split("/"):
        glob = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", part))
        steps.append("(?:[^/]+/)*" if part == "**" else glob + "/")
    return re.compile(("^" if rooted else "(?:^|/)") + "".join(steps))


def _ignored(path: str, ignore_files: dict[str, str]) -> bool:
    parts = path.split("/")
    for depth in range(1, len(parts) + 1):
        decision = False
        for base in range(depth):
            for raw in ignore_files.get("/".join(parts[:base]), "").split("\n"):
                line = raw.strip()
                if not line or line.startswith("#"):
                    continue
                line = line[1:] if line.startswith("\\") else line
                negated = raw.strip().startswith("!")
                body = line.removeprefix("!") if negated else line
                anchored, only = body.startswith("/"), body.endswith("/")
                body = body.strip("/")
                below = parts[base:depth]
                if only and depth == len(parts):
                    below = below[:-1]
                if below and _pattern(body, anchored or "/" in body).search("/".join(below) + "/"):
                    decision = not negated
        if decision:
            return True
    return False


def test_random_rules(spark):
    rng = random.Random(3)
    names = ["a", "b", "c", "d", "build", "keep.log", "k.log", "x1.txt", "n.md", "#odd"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(250)})
    df = spark.createDataFrame([(p,) for p in [*paths, *paths[:5], None]], "path string")
    for folders in (["", "a", "a/b", "d", "c/c"], ["a", "b"], [""], []):
        ignore_files = {folder: "\n".join(rng.choice(LINES) for _ in range(6)) for folder in folders}
        rules = files.ignore_rules(spark.createDataFrame(list(ignore_files.items()), "folder string, content string"))
        got = sorted(r["path"] for r in files.ignored_paths(df, rules).collect())
        assert got == [p for p in paths if _ignored(p, ignore_files)]
        assert files.ignored_paths(df.limit(0), rules).count() == 0
