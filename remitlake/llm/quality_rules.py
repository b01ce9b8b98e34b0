"""Quality rules: line-first cleaning.

Every line is judged alone: it fails if it has words but hardly a letter (punctuation), if it is
a menu of separated items or a bare navigation phrase, if most of its words carry symbols or
shout, if it is known boilerplate, or if it repeats an earlier long line. Failing lines are
removed, and a document that loses more than ``max_loss`` of its words is rejected.

Base figures stand beside the method: words, symbols, repeated lines and repeated 5-word
windows; a document fails at once with under 10 words or with over 20 % of its words in
repeated windows.

Defined results: null and empty texts have no words, fail the base rule and are not kept;
repeated rows are judged alike; an empty table gives an empty result; other columns, null or
not, are carried along (but for the names of the figures).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

_SYMBOLS = frozenset(b"#*$%&|<>")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SPACES = re.compile(r"[\x20\x09-\x0D]")
_LETTER = re.compile(r"[^\W\d_]")
_MENU = re.compile(r"\s[|»›>·•]\s")
# Lines that are navigation or boilerplate as a whole, in lower case.
_NAVIGATION = re.compile(r"(?:home|menu|skip to (?:main )?content|next page|previous page|back to top|read more|log ?in|sign (?:in|up)|share this|search)[\s.:!>»]*", re.I)
_BOILERPLATE = re.compile(r"(?:we use cookies|this (?:web)?site uses cookies|accept (?:all )?cookies|please enable javascript|javascript is (?:disabled|required)|subscribe to our newsletter)\b.*", re.I)

FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_words long, kept boolean"


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that stand in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    keys = ids[:n]
    for k in range(1, window):
        # Renumbering keeps the pairs exact wherever the product could overflow.
        top = int(keys.max()) + 1
        if top * len(known) >= 1 << 62:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * len(known) + ids[k : k + n]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, np.flatnonzero(twice), 1)
    np.add.at(mark, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def line_fails(line: str, words: list[bytes]) -> bool:
    """Whether a line fails by itself; ``words`` are its words between ASCII white space, in UTF-8."""
    n = len(words)
    if not _LETTER.search(line):
        return True
    if len(menus := _MENU.findall(line)) >= 2 and 3 * len(menus) >= n - len(menus):
        return True
    if n <= 12 and (_NAVIGATION.fullmatch(line.strip()) or _BOILERPLATE.fullmatch(line.strip())):
        return True
    if n < 4:
        return False
    if 2 * len(_SYMBOL.findall(line)) > n and 2 * sum(not _SYMBOLS.isdisjoint(w) for w in words) > n:
        return True
    if ("!!" in line or "??" in line) and 2 * sum(w.endswith((b"!!", b"??")) for w in words) > n:
        return True
    return n >= 8 and 2 * len(set(words)) < n and 2 * sum(a == b for a, b in zip(words, words[1:], strict=False)) > n


def judge(text: str, max_loss: float) -> tuple[list[object], list[str]]:
    """Figures of :data:`FIGURES` and the lines that stay."""
    words: list[bytes] = []
    seen: set[str] = set()
    stays: list[str] = []
    dup = lost = 0
    for line in text.split("\n"):
        here = line.encode("utf-8", "surrogatepass").split()  # bytes: only ASCII white space splits
        if not here:
            stays.append(line)
            continue
        words += here
        again = line in seen
        dup += again
        seen.add(line)
        if (again and len(here) >= 4) or line_fails(line, here):
            lost += len(here)
        else:
            stays.append(line)
    n_words, repeats = len(words), repeated_words(words)
    base_failed = n_words < 10 or 100 * repeats > 20 * n_words
    kept = not base_failed and lost <= max_loss * n_words
    return [n_words, len(text) - len(_SPACES.findall(text)), len(_SYMBOL.findall(text)), dup, repeats, base_failed, lost, kept], stays


def clean(docs: DataFrame, text_col: str = "text", max_loss: float = 0.5, in_place: bool = False) -> DataFrame:
    """Adds the figures to ``docs``, and ``clean_text`` (the lines that stay), or puts that in the text's place."""
    names = [x.split()[0] for x in FIGURES.split(", ")]
    added = names if in_place else [*names, "clean_text"]
    carried = docs.select([f.name for f in docs.schema if f.name not in added])
    out = T.StructType([*carried.schema.fields, *T.StructType.fromDDL(FIGURES), *[T.StructField("clean_text", T.StringType())] * (not in_place)])
    at = carried.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_()]
        for b in C.slices(batches, text_col):
            judged = [judge(t or "", max_loss) for t in b.column(text_col).to_pylist()]
            cols = [pa.array([x[0][i] for x in judged], kind) for i, kind in enumerate(kinds)]
            texts = pa.array(["\n".join(x[1]) for x in judged], pa.string())
            given = list(b.columns)
            if in_place:
                given[at] = texts
            yield pa.RecordBatch.from_arrays([*given, *cols, *[texts] * (not in_place)], out.names)

    return carried.mapInArrow(run, out)


def op9_quality_rules(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")
