"""License scans: TF-IDF cosine of lines to licence templates, and inheritance from the nearest directory above.

Every line of every text is a sparse vector of hashed words, weighted by how few lines of the corpus have them; the
document frequencies are counted over all lines, as one fixed-size array of buckets. Lines are compared with statements
of one sentence, and a similar line counts only if it has the words by which the licence differs from others, none of
another's and no negation (`names_licence`); for whole notices and licence texts (`license_notices`), which wrap over lines, so is every window of
words as long as the notice, over the whole text. Windows are looked at only in texts that hold enough of a notice's
weight to be similar at all, which loses none. Where similar windows overlap the most similar counts, and a line inside
one says no more. A line as similar to one licence as to another names neither. A file has all licences found, and first
the one of its most similar window, or of its most similar line without any. A file without one takes the licences of
the nearest directory above it that has a licence file; directories are joined by path, each distinct directory once.

Defined cases: a null or empty text has no lines and no licence of its own; a null path lies in no directory, and
inherits nothing; repeated rows give equal rows; of equally similar windows the first by licence counts, of equally good
licence files the first by path; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.core import checkpointed

from .arrays import LOWER, Words, blocks, byte_hasher, text_bytes
from .license_notices import NOTICES
from .toxicity import NOT_ALPHANUMERIC

BUCKETS = 1 << 16
SIMILAR = 0.6
#: Cosine from which a window of words is a notice.
NOTICE_SIMILAR = 0.85
#: Names of licence files.
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|copyright|notice)([.-].*)?$"

# Names of common licences, how texts state them, and other statements.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "MPL 2.0"],
}
FORMS = ["{}", "{} or later", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}."]
OTHER = {
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved."],
}
# What tells the licences apart, and other words for it.
KINDS = set("gnu lesser affero apache bsd mit isc mozilla cc nc nd sa".split())
SAME = {
    "gpl": "gnu", "gplv2": "gnu 2", "gplv3": "gnu 3", "lgpl": "gnu lesser", "lgplv3": "gnu lesser 3", "agpl": "gnu affero", "agplv3": "gnu affero 3", "mpl": "mozilla",
    "creative": "cc", "noncommercial": "nc", "commercial": "nc", "sharealike": "sa", "alike": "sa", "noderivatives": "nd", "noderivs": "nd", "derivatives": "nd",
    "v2": "2", "v3": "3", "v4": "4",
}
VERSIONS = set("1 2 3 4".split())
NEGATIONS = set("not no never nor isn aren wasn cannot unlike without".split())
#: One of these stands in every line that names a licence.
LICENCE_WORDS = set("license licence licensed licenced licensing spdx gpl gplv2 gplv3 lgpl lgplv3 agpl agplv3 mpl cc commons".split())

TEMPLATES = {
    name: [form.format(title) for title in NAMES.get(name, []) for form in FORMS] + ([f"SPDX-License-Identifier: {name}"] if name in NAMES else []) + OTHER.get(name, [])
    for name in sorted({*NAMES, *OTHER})
}
_WORD = re.compile(r"[^\W_]+")


def stated_kinds(text: str) -> tuple[list[str], set[str], set[str]]:
    """(words, kinds of licences, versions) that a line names; conditions of Creative Commons count only beside it."""
    words = _WORD.findall(text.lower())
    meant = {m for w in words for m in SAME.get(w, w).split()}
    kinds = meant & KINDS
    return words, kinds if "cc" in kinds else kinds - {"nc", "nd", "sa"}, meant & VERSIONS


def names_licence(text: str, licence: str, template: str) -> bool:
    """Whether a line that is similar to a licence's statement says so: it has the kinds and the version by which the
    licence differs from others and none of another, no negation beside the statement's own, and `all rights reserved`
    as it stands."""
    words, kinds, versions = stated_kinds(text)
    own_words, own_kinds, own_versions = stated_kinds(template)
    if set(words) & NEGATIONS - set(own_words):
        return False
    if licence == "all-rights-reserved":
        return not kinds and "all rights reserved" in " ".join(words)
    if not own_kinds:  # a statement that names no licence
        return kinds <= stated_kinds(licence)[1]
    return kinds == own_kinds and (not own_versions or versions == own_versions) and bool(LICENCE_WORDS.intersection(words))


def word_buckets(words: Words) -> np.ndarray:
    return (byte_hasher(LOWER[words.data]).spans(words.starts, words.ends) % np.uint64(BUCKETS)).astype(np.int64)


def line_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each line, sorted by line: (line, bucket, times), and the document and number of each line."""
    words = Words(data, offsets, NOT_ALPHANUMERIC)
    bucket = word_buckets(words)
    newlines = np.flatnonzero(data == 10)
    owner = words.documents()
    # lines are numbered through the block: each document starts one, and each newline
    line = np.searchsorted(newlines, words.starts) + owner
    first = np.searchsorted(newlines, offsets[:-1]) + np.arange(len(offsets) - 1)
    pairs, times = np.unique(line * BUCKETS + bucket, return_counts=True)
    used, place = np.unique(pairs // BUCKETS, return_inverse=True)
    document = np.searchsorted(first, used, side="right") - 1
    return place, pairs % BUCKETS, times, document, used - first[document]


def line_frequencies(files: DataFrame, text: str = "text") -> np.ndarray:
    """For each bucket, in how many lines of all texts it occurs; after the last, the number of lines with words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for block in blocks(batches, "text"):
            _, bucket, _, document, _ = line_terms(*text_bytes(block["text"]))
            total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
            total[BUCKETS] += len(document)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    rows = files.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows["bucket"].to_numpy(int)] = rows["n"]
    return out


def inverse_frequencies(frequencies: np.ndarray) -> np.ndarray:
    return np.log((1 + frequencies[BUCKETS]) / (1 + frequencies[:BUCKETS])) + 1


def template_vectors(idf: np.ndarray, templates: dict[str, list[str]] = TEMPLATES) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(names, statements, their unit vectors over the buckets that any of them has, place of each bucket or -1)."""
    names = [name for name in sorted(templates) for _ in templates[name]]
    statements = [t for name in sorted(templates) for t in templates[name]]
    texts = [t.encode() for t in statements]
    data = np.frombuffer(b"".join(texts), np.uint8)
    line, bucket, times, _, _ = line_terms(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    used = np.unique(bucket)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    out = np.zeros((len(texts), len(used)), np.float32)
    out[line, place[bucket]] = times * idf[bucket]
    return names, statements, out / np.linalg.norm(out, axis=1, keepdims=True), place


def line_cosines(line: np.ndarray, bucket: np.ndarray, weight: np.ndarray, n: int, vectors: np.ndarray, place: np.ndarray, step: int = 1 << 14) -> Iterator[tuple[int, np.ndarray]]:
    """(line, its cosines to all templates) of the lines that have a template's word."""
    norm = np.maximum(np.sqrt(np.bincount(line, weight**2, minlength=n)), 1e-12)
    hit = np.flatnonzero(place[bucket] >= 0)
    used, row = np.unique(line[hit], return_inverse=True)
    for at in range(0, len(used), step):
        own = hit[(row >= at) & (row < at + step)]
        sparse = np.zeros((min(step, len(used) - at), vectors.shape[1]), np.float32)
        sparse[np.searchsorted(used, line[own]) - at, place[bucket[own]]] = weight[own]
        cosines = sparse @ vectors.T
        cosines /= norm[used[at : at + step], None]
        yield from zip(used[at : at + step].tolist(), cosines)


def line_span(data: np.ndarray, offsets: np.ndarray, document: int, number: int) -> tuple[int, int]:
    """Where a line of a document begins and ends."""
    start, stop = int(offsets[document]), int(offsets[document + 1])
    ends = np.flatnonzero(data[start:stop] == 10) + start
    return (start if number == 0 else int(ends[number - 1]) + 1), (int(ends[number]) if number < len(ends) else stop)


class Notices:
    """The notices as unit vectors over the buckets that any of them has."""

    def __init__(self, idf: np.ndarray, notices: dict[str, list[str]] = NOTICES):
        self.idf = idf
        self.names = [name for name in sorted(notices) for _ in notices[name]]
        texts = [np.frombuffer(t.encode(), np.uint8) for name in sorted(notices) for t in notices[name]]
        found = [word_buckets(Words(t, np.array([0, len(t)]), NOT_ALPHANUMERIC)) for t in texts]
        self.lengths = [len(f) for f in found]
        used = np.unique(np.concatenate(found))
        self.place = np.full(BUCKETS, -1, np.int16)
        self.place[used] = np.arange(len(used))
        self.vectors = np.zeros((len(found), len(used)), np.float64)
        for row, f in zip(self.vectors, found):
            np.add.at(row, self.place[f], idf[f])
        self.vectors /= np.linalg.norm(self.vectors, axis=1, keepdims=True)

    def candidates(self, document: np.ndarray, bucket: np.ndarray, n: int, threshold: float) -> np.ndarray:
        """(document, notice) flags of the pairs that can be similar: by Cauchy's inequality, words that a text doesn't
        have hold at most 1 - threshold ** 2 of the squared length of a notice that is similar to a part of it."""
        present = np.zeros((n, self.vectors.shape[1]), np.float64)
        hit = self.place[bucket] >= 0
        present[document[hit], self.place[bucket[hit]]] = 1
        return present @ (self.vectors**2).T >= threshold**2 - 1e-9

    def windows(self, bucket: np.ndarray, notice: int) -> np.ndarray:
        """Cosine to the notice of the window of words that begins at each word; the last ones end with the text."""
        idf, length = self.idf, self.lengths[notice]
        weight = np.where(self.place[bucket] >= 0, self.vectors[notice][self.place[bucket]], 0) * idf[bucket]
        sums = np.concatenate([[0], np.cumsum(weight)])
        ends = np.minimum(np.arange(len(bucket)) + length, len(bucket))
        # squared lengths as the window slides: a word that comes n + 1 times adds (2 n + 1) times its squared weight
        times: dict[int, int] = {}
        square, at, squares = 0.0, 0, np.zeros(len(bucket))
        words, costs, stops = bucket.tolist(), (idf[bucket] ** 2).tolist(), ends.tolist()
        for start, stop in enumerate(stops):
            while at < stop:
                n = times.get(words[at], 0)
                square += (2 * n + 1) * costs[at]
                times[words[at]] = n + 1
                at += 1
            squares[start] = square
            n = times[words[start]]
            square -= (2 * n - 1) * costs[start]
            times[words[start]] = n - 1
        return (sums[ends] - sums[:-1]) / np.sqrt(np.maximum(squares, 1e-12))

    def find(self, data: np.ndarray, notices: np.ndarray, threshold: float) -> list[tuple[float, str, int, int]]:
        """(cosine, licence, first line, last line) of the similar windows of one text, of overlapping ones the best."""
        words = Words(data, np.array([0, len(data)]), NOT_ALPHANUMERIC)
        bucket = word_buckets(words)
        newlines = np.flatnonzero(data == 10)
        hits = []
        for k in notices.tolist():
            cosine = self.windows(bucket, k)
            hits += [(-float(cosine[w]), self.names[k], w, min(w + self.lengths[k], len(bucket))) for w in np.flatnonzero(cosine >= threshold).tolist()]
        taken, out = np.zeros(len(bucket), bool), []
        for minus, name, start, stop in sorted((round(h[0], 9), *h[1:]) for h in hits):
            if not taken[start:stop].any():
                taken[start:stop] = True
                out.append((-minus, name, int(np.searchsorted(newlines, words.starts[start])), int(np.searchsorted(newlines, words.starts[stop - 1]))))
        return out


def own_licences(
    files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), threshold: float = SIMILAR, notice_threshold: float = NOTICE_SIMILAR
) -> DataFrame:
    """path, `keep` columns, licence (null if none is similar enough), cosine and number of the most similar line (the
    first of a notice), and all licences by name."""
    idf = inverse_frequencies(line_frequencies(files, text))
    names, texts, vectors, place = template_vectors(idf)
    shared = files.sparkSession.sparkContext.broadcast((idf, names, texts, vectors, place, Notices(idf)))
    source = files.select(F.col(path).alias("path"), F.col(text).alias("text"), *keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, names, texts, vectors, place, notices = shared.value
        for block in blocks(batches, "text"):
            data, offsets = text_bytes(block["text"])
            line, bucket, times, document, number = line_terms(data, offsets)
            cosine, named = np.zeros(len(document)), []
            for k, row in line_cosines(line, bucket, times * idf[bucket], len(document), vectors, place):
                cosine[k] = row.max()
                if cosine[k] >= threshold:
                    start, stop = line_span(data, offsets, int(document[k]), int(number[k]))
                    said = bytes(data[start:stop]).decode("utf-8", "replace")
                    best = [(round(-float(row[t]), 9), names[t]) for t in np.flatnonzero(row >= threshold) if names_licence(said, names[t], texts[t])]
                    best = sorted(set(best))
                    if best and all(c > best[0][0] for c, name in best if name != best[0][1]):
                        named.append((k, best[0][1], -best[0][0]))
            found: list[list[tuple[float, str, int, int]]] = [[] for _ in range(block.num_rows)]
            can = notices.candidates(document[line], bucket, block.num_rows, notice_threshold)
            for d in np.flatnonzero(can.any(axis=1)).tolist():
                found[d] = notices.find(data[offsets[d] : offsets[d + 1]], np.flatnonzero(can[d]), notice_threshold)
            # the most similar line of every file, for its cosine, and the lines that name a licence
            top = np.zeros(block.num_rows)
            np.maximum.at(top, document, cosine)
            for k, name, value in sorted(named, key=lambda x: (document[x[0]], -x[2], number[x[0]])):
                d, n = int(document[k]), int(number[k])
                if not any(first <= n <= last for *_, first, last in found[d]):
                    found[d].append((value, name, n, n - 1))
            yield pa.RecordBatch.from_arrays(
                [block["path"]]
                + [block[k] for k in keep]
                + [
                    pa.array([f[0][1] if f else None for f in found], pa.string()),
                    pa.array([f[0][0] if f else float(c) for f, c in zip(found, top)], pa.float64()),
                    pa.array([f[0][2] if f else None for f in found], pa.int64()),
                    pa.array([sorted({h[1] for h in f}) for f in found], pa.list_(pa.string())),
                ],
                names=["path", *keep, "licence", "cosine", "line", "licences"],
            )

    fields = ["path string", *[f"{k} {source.schema[k].dataType.simpleString()}" for k in keep], "licence string, cosine double, line long, licences array<string>"]
    return source.mapInArrow(scan, ", ".join(fields))


def directory_of(path: Column) -> Column:
    """The path before the last slash, empty for a file at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def inherited_licences(found: DataFrame) -> DataFrame:
    """The files with `source` ("own", "inherited" or null) and, for an inherited licence, the directory it is from."""
    placed = found.withColumn("directory", directory_of(F.col("path")))
    name = F.element_at(F.split("path", "/"), -1)
    stated = placed.filter(F.col("licence").isNotNull() & name.rlike(LICENCE_FILE))
    best = F.min_by(F.struct("licence", "licences"), F.struct(-F.col("cosine"), F.col("path")))
    of_directory = stated.groupBy("directory").agg(best.alias("given")).withColumnRenamed("directory", "above")
    parts = F.split("directory", "/")
    every = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    ancestors = placed.select("directory").filter(F.col("directory").isNotNull()).distinct()
    ancestors = ancestors.select("directory", F.posexplode(F.array_distinct(every)).alias("depth", "above"))
    nearest = ancestors.join(of_directory, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "given")).alias("nearest"))
    joined = placed.join(nearest, "directory", "left")
    own = F.col("licence").isNotNull()
    return joined.select(
        *[c for c in found.columns if c not in ("licence", "licences")],
        F.coalesce("licence", "nearest.given.licence").alias("licence"),
        F.when(~own & F.col("nearest.given").isNotNull(), F.col("nearest.given.licences")).otherwise(F.col("licences")).alias("licences"),
        F.when(own, "own").when(F.col("nearest.given").isNotNull(), "inherited").alias("found_in"),
        F.when(~own, F.col("nearest.above")).alias("inherited_from"),
    )


def scan_licences(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    # read for licence files, for the directories above and for the result: the texts are scanned once
    return inherited_licences(checkpointed(own_licences(files, path, text, keep)))
