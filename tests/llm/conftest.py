from __future__ import annotations

import random

import pytest

#: Extra columns named like columns that operators make on their way.
EXTRA = "pack_id long, bucket string, size string, taken int, uid string, label string, n double, pattern string"


def odd_texts() -> list[str | None]:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(25)
    base = prose(120).split()
    near = []
    for k in range(4):
        w = list(base)
        w[10 * k + 5] = f"x{k}"
        near.append(" ".join(w))
    out: list[str | None] = [None, "", " \n\t ", "one", "Two Words", "two words", "é " * 30, "a" * 700, "ab" * 300, "tick " * 400, prose(9000)]
    out += [passage, f"{prose(30)} {passage} {prose(30)}", f"{prose(12)} {passage}", f"{passage} {passage}", f"{line}\n{prose(50)}\n{line}"]
    out += ["x " + " ".join(base), " ".join(base), " ".join(base), *near]
    out += ["é" * 80 + " " + line, "ü" * 80 + " " + line, "no\u00a0break\u2003space " * 12, "tab\tand\x0bvertical\x0cfeed " * 10, "<|endoftext|> it's <|endoftext|>", "中文字符 测试 " * 30]
    out += [prose(rng.randint(1, 80)) for _ in range(20)]
    return out


def odd_rows() -> list[tuple]:
    rows = [(k * 3, t, ("en", "de", None)[k % 3], ("b", "a", None, "c")[k % 4]) for k, t in enumerate(odd_texts())]
    rows += [(30, rows[10][1], "en", "b"), (9, "one", "en", "a"), (None, rows[11][1], None, None), (None, None, None, None)]
    random.Random(1).shuffle(rows)
    return [(i, t, lang, s, None if t is None else len(t), k, "b", "s", 1, "u", "l", 0.5, "p") for k, (i, t, lang, s) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in all columns, empty, long and repeated texts, repeated rows, extra columns; in several partitions."""
    return spark.createDataFrame(odd_rows(), f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(5)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def in_order(rows) -> list:
    """Rows as operators take them: by doc_id, nulls last.  Equal ids hold equal texts here, or don't repeat."""
    return sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
