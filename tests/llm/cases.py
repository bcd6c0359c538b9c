"""Small tables with the hard cases, and plain-Python statements of the rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, seg string, c string, row string, z string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def texts(seed: int = 1, n: int = 40) -> list[tuple[int | None, str | None]]:
    """Ids and texts: nulls, empty and blank texts, one word, a long text without and one with blanks, other
    scripts, copies with other cases, edited copies, shared lines and passages, and a repeated row."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = prose(70), "Common LINE  \t"
    out: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "x" * 5000), (6, prose(4000)), (7, "日本語のテキスト 한국어 текст"),
        (8, "12 34 %% --"), (9, "a\n\n\nb\n"), (10, "tie tie tie tie tie " * 40), (None, prose(80)), (None, passage)]
    for i in range(n):
        body = prose(rng.randint(20, 150))
        if i % 3 == 0:
            body = f"{prose(10)} {passage} {prose(10)}"
        if i % 2 == 0:
            body = f"{line if i % 4 else line.lower().strip()}\n{body}"
        out.append((100 + i, body))
    base = prose(200).split()
    for i in range(8):  # near copies of one text, one or two words changed
        words = list(base)
        words[rng.randrange(200)] = f"changed{i}"
        out.append((200 + i, " ".join(words)))
    out += [(300, out[-1][1]), (301, out[-1][1].upper()), (302, out[20][1]), (302, out[20][1])]
    return out


def table(spark: SparkSession, rows=None) -> DataFrame:
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None, None, "seg", "c", "row", "z") for i, t in rows], SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")
