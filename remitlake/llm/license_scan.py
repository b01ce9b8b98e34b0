"""License scan by diagonal voting.

One pass over the texts splits them into words, finds the fixed phrases and short notices, and
hashes all rolling word ``k``-grams; Spark joins those to the positions of the same grams in
license templates. A hit votes for the diagonal ``text position - template position``;
diagonals of a text and template that lie within ``slack`` of each other are merged, so that an
inserted or lost word does not split a notice. A merged candidate is then verified word by
word: its identity is the share of the template's words that stand in the text on one of its
diagonals, and it counts from ``least`` on, unless the words it spans hold a qualifier (``QUALIFIERS``)
that the template has not: another licence.

Notices of ``SHORT`` words have too few grams for that. They are sought with one edit: a word
lost, replaced or put in. Key words (``KEYS``, and numbers) are neither edited nor put in, as they
tell one licence from another.

Beside that, three fixed phrases are found exactly. ``labels`` has both, ``score`` is the best
identity of a verified notice (0 without any), ``spans`` are the verified notices with their first
and last word.

Defined results: null and empty texts have no words and no labels; rows that agree in doc_id
and text (nulls included) share their result and stay rows of their own; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

# Phrases of the base scan and public license notices, as plain text.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    # Short notices in other common words.
    ("apache-2.0", "Licensed under the Apache 2.0 License"),
    ("apache-2.0", "Licensed under Apache License 2.0"),
    ("mit", "Licensed under the MIT License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-3.0", "Licensed under CC BY 3.0"),
    ("cc-by-nc-3.0", "Licensed under CC BY-NC 3.0"),
    ("cc-by-sa-3.0", "Licensed under CC BY-SA 3.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("gpl-3.0", "Licensed under the GNU GPL version 3"),
    ("mpl-2.0", "Licensed under the Mozilla Public License 2.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    # The other clauses of the long licences.
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache-2.0", "See the License for the specific language governing permissions and limitations under the License"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc", "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
)
#: Templates of so many words are sought with one edit.
SHORT = range(5, 10)
#: Words of short templates that are not edited, besides numbers.
KEYS = frozenset("apache mit bsd isc mozilla mpl cc by nc sa nd gnu gpl lgpl agpl lesser affero library general public".split())
#: Words that make another licence of a notice.
QUALIFIERS = ("nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "noderivs", "lesser", "affero", "library")
SPAN = "struct<label:string,identity:double,first_word:bigint,last_word:bigint>"
MARKS = f"doc_id long, __t long, n_words long, n_base long, first_word long, last_word long, __base array<string>, __short array<{SPAN}>, grams array<long>"
# Bytes outside words become spaces, A to Z small; all bytes from 128 on belong to characters of words.
_WORD_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def _is_key(word: str) -> bool:
    return word in KEYS or word.isdigit()


def _with_one_edit(words: list[str]) -> str:
    """Pattern of a short notice, each word after a space, with at most one word edited that is no key."""
    plain = lambda ws: "".join(f" {w}" for w in ws)
    other = f" (?!(?:{'|'.join(sorted(KEYS))}|[0-9]+) )[^ ]+"
    forms = [plain(words)]
    for j, w in enumerate(words):
        if j:
            forms.append(plain(words[:j]) + other + plain(words[j:]))
        if not _is_key(w):
            forms += [plain(words[:j]) + other + plain(words[j + 1 :])] * (0 < j < len(words) - 1) + [plain(words[:j] + words[j + 1 :])]
    return f"(?:{'|'.join(forms)})(?= )"


class Scanner:
    """Words, phrases, short notices and gram hashes of texts; words' hashes are kept up to a bound."""

    def __init__(self, k: int = 3, limit: int = 200_000):
        self.k, self.limit = k, limit
        self.hashes: dict[bytes, int] = {}
        self.phrases = [([w.encode() for w in p.split()], label) for p, label in PHRASES.items()]
        short = [(label, [w.decode() for w in _words(t)]) for label, t in TEMPLATES]
        self.short = [
            (label, frozenset(w.encode() for w in ws), frozenset(w.encode() for w in ws if w in KEYS), re.compile(_with_one_edit(ws).encode()), len(ws), "".join(f" {w}" for w in ws).encode())
            for label, ws in short if len(ws) in SHORT
        ]

    def grams(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(words) < self.k:
            return np.zeros(0, np.int64)
        if len(self.hashes) > self.limit:
            self.hashes.clear()
        known = self.hashes
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array(list(map(known.__getitem__, words)), np.uint64)
        out = np.zeros(len(h) - self.k + 1, np.uint64)
        for j in range(self.k):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : len(h) - self.k + 1 + j]
        return (out ^ (out >> np.uint64(32))).view(np.int64)

    def places(self, words: list[bytes], held: set[bytes]) -> list[tuple[int, str]]:
        """Places of the phrases."""
        out = []
        for phrase, label in self.phrases:
            if held.issuperset(phrase):
                out += [(i, label) for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]
        return out

    def notices(self, words: list[bytes], held: set[bytes]) -> list[dict]:
        """Spans of the short notices; a match lacks one of the template's words at most."""
        out, line = [], None
        for label, template, keys, pattern, n, whole in self.short:
            if len(template - held) > 1 or not keys <= held:
                continue
            line = line or b" " + b" ".join(words) + b" "
            for m in pattern.finditer(line):
                first, size = line.count(b" ", 0, m.start()), m[0].count(b" ")
                out.append({"label": label, "identity": 1.0 if size > n or m[0] == whole else (n - 1) / n, "first_word": first, "last_word": first + size - 1})
        return out


def marks(docs: DataFrame, k: int) -> DataFrame:
    """One row per row of ``docs``: the figures of :data:`MARKS`, from one look at each text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner = C.kept(f"licenses {k}", lambda: Scanner(k))
        for b in C.slices(batches, "text"):
            n, at, bases, short, grams = [], [], [], [], []
            for t in b.column("text").to_pylist():
                words = _words(t)
                held = set(words)
                places = scanner.places(words, held)
                n.append(len(words))
                at.append([p for p, _ in places])
                bases.append(sorted({label for _, label in places}))
                short.append(scanner.notices(words, held))
                grams.append(scanner.grams(words))
            span = pa.struct([("label", pa.string()), ("identity", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(g) for g in grams])]), pa.int32())
            longs = [pa.array(x, pa.int64()) for x in (n, [len(p) for p in at], [min(p, default=None) for p in at], [max(p, default=None) for p in at])]
            columns = [*(b.column(c) for c in ("doc_id", "__t")), *longs, pa.array(bases, pa.list_(pa.string())), pa.array(short, pa.list_(span)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(grams)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "__t", "n_words", "n_base", "first_word", "last_word", "__base", "__short", "grams"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(C.text_or_empty()).alias("__t"), C.text_or_empty().alias("text"))
    return rows.mapInArrow(run, MARKS)


def template_grams(spark: SparkSession, k: int) -> DataFrame:
    """(gram, template, at) with the hash of every gram of the templates."""
    scanner = Scanner(k)
    rows = [(int(g), t, i) for t, (_, text) in enumerate(TEMPLATES) for i, g in enumerate(scanner.grams(_words(text)))]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def candidates(hits: DataFrame, k: int, slack: int, share: float) -> DataFrame:
    """Merged diagonals by doc_id, __t and template that hold ``share`` of the template's grams."""
    sizes = F.array(*[F.lit(len(_words(t))) for _, t in TEMPLATES])
    votes = hits.groupBy("doc_id", "__t", "template", "diagonal").agg(F.collect_set("at").alias("ats"))
    ordered = Window.partitionBy("doc_id", "__t", "template").orderBy("diagonal")
    marked = votes.withColumn("__new", (F.col("diagonal") - F.lag("diagonal").over(ordered) > slack).cast("int"))
    marked = marked.withColumn("island", F.sum(F.coalesce("__new", F.lit(1))).over(ordered))
    merged = marked.groupBy("doc_id", "__t", "template", "island").agg(F.collect_list("diagonal").alias("diagonals"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"))
    return merged.where(F.col("votes") >= share * (F.get(sizes, F.col("template")) - k + 1)).select("doc_id", "__t", "template", "diagonals")


def verified_notices(pairs: DataFrame, least: float) -> DataFrame:
    """(doc_id, __t, span) of candidates (doc_id, __t, text, template, diagonals) that hold ``least`` of the template's words on their diagonals and no qualifier that it has not."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        templates = [(label, _words(t)) for label, t in TEMPLATES]
        qualifiers = {q.encode() for q in QUALIFIERS}
        for b in C.slices(batches, "text"):
            kept, spans = [], []
            for row, (text, template, diagonals) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "template", "diagonals")), strict=True)):
                words, (label, wanted) = _words(text), templates[template]
                places = [next((i + d for d in diagonals if 0 <= i + d < len(words) and words[i + d] == w), None) for i, w in enumerate(wanted)]
                places = [p for p in places if p is not None]
                if len(places) < least * len(wanted):
                    continue
                first, last = min(places), max(places)
                if qualifiers.intersection(words[first : last + 1]).difference(wanted):
                    continue
                kept.append(row)
                spans.append({"label": label, "identity": len(places) / len(wanted), "first_word": first, "last_word": last})
            span = pa.struct([("label", pa.string()), ("identity", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(kept, pa.int64())) for c in ("doc_id", "__t")), pa.array(spans, span)], ["doc_id", "__t", "span"])

    return pairs.mapInArrow(run, f"doc_id long, __t long, span {SPAN}")


def scan(docs: DataFrame, k: int = 3, slack: int = 3, share: float = 0.3, least: float = 0.9, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id and the columns of the scan.

    Candidates go to the texts by a broadcast up to ``broadcast_bytes``, by a shuffle beyond.
    """
    spark = docs.sparkSession
    # The templates are fixed text, several hundred grams. A row without a gram carries a text's own figures.
    spread = marks(docs, k).select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("long")), "grams")).alias("pos", "gram")).drop("grams")
    found = spread.join(F.broadcast(template_grams(spark, k)), "gram", "left").where("pos = 0 or template is not null")
    own = F.col("pos") == 0
    figures = [F.when(own, F.col(c)).alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "__base", "__short")]
    found = C.materialise(found.select("doc_id", "__t", *figures, own.alias("own"), "template", (F.col("pos") - 1 - F.col("at")).alias("diagonal"), "at"), "marks")
    base = found.where("own").drop("own", "template", "diagonal", "at")
    diagonals = C.materialise(candidates(found.where("not own"), k, slack, share), "candidates")
    size = diagonals.agg(F.sum(48 + 8 * F.size("diagonals"))).first()[0] or 0
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(C.text_or_empty()).alias("__t"), C.text_or_empty().alias("text"))
    pairs = keyed.alias("x").join(F.broadcast(diagonals.alias("c")) if size <= broadcast_bytes else diagonals.alias("c"), F.col("x.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("x.__t") == F.col("c.__t")))
    long = verified_notices(pairs.select("x.doc_id", "x.__t", "text", "template", "diagonals"), least)
    # rows that agree in doc_id and text find the same, once each
    verified = long.groupBy("doc_id", "__t").agg(F.collect_set("span").alias("__long"))
    both = base.alias("b").join(verified.alias("v"), F.col("b.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("b.__t") == F.col("v.__t")), "left")
    spans = F.array_sort(F.array_union("__short", F.coalesce("__long", F.array().cast(f"array<{SPAN}>"))))
    both = both.select(F.col("b.doc_id"), "n_words", "n_base", "first_word", "last_word", "__base", spans.alias("spans"))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base", "spans.label")), ",").alias("labels"), F.coalesce(F.array_max("spans.identity"), F.lit(0.0)).alias("score"), "spans",
    )


def op6_license_scan(spark, sf_dir):
    return scan(C.table(spark, sf_dir, "documents"))
