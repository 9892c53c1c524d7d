"""License scans (operator 5): MinHash bands over overlapping windows of words retrieve templates.

Templates fall into classes of about one size; the windows of a class are as long as its largest template and
begin at every word.  The number of one-row bands follows from the least likeness between a template and the
window that holds its required share, so that a match is retrieved with the chance 1 - MISS at least.
Retrieved templates are verified on exact shingle containment in the document.
Classes of whole texts and headers look only at documents with enough of the class's shingles, which is counted
exactly beforehand and loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

U = np.uint64
MISS = 1e-6
#: Sizes of the templates of a class lie within this factor.
CLASS_RATIO = 1.25
#: Templates that a task is given at a time.
TEMPLATE_BYTES = 8 << 20
#: Classes whose least template has more shingles than this are looked for only where enough of their shingles are.
LONG = 40

# Notices that texts carry.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


@cache
def whole_texts() -> dict[str, str]:
    """License texts without copyright lines and appendices, and full headers, by the name of their file."""
    return {f"{f.stem}-text": f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def bands_for(sizes: list[int], window: int, share: float) -> int:
    """One-row bands so that any template of the class, at the share, meets its window in one with the chance 1 - MISS."""
    least = min(math.ceil(share * s) / (window + s - math.ceil(share * s)) for s in sizes)
    return 1 if least >= 1 else math.ceil(math.log(MISS) / math.log1p(-least))


def template_classes(templates: dict[str, str], k: int, share: float) -> list[dict]:
    """Classes with their shingle width, window, bands and the minima and sets of their templates."""
    names = sorted(templates)
    data, offsets = K.buffers(pa.array([templates[x] for x in names], pa.string()))
    elements, at = K.shingle_sets(data, offsets, k)
    words = np.diff(K.words(data, offsets)[3])
    sets = sorted(((min(int(words[i]), k), int(at[i + 1] - at[i]), x, elements[at[i] : at[i + 1]]) for i, x in enumerate(names) if words[i]), key=lambda t: t[:3])
    classes: list[dict] = []
    for width, size, name, own in sets:
        last = classes[-1] if classes else None
        if last is None or last["width"] != width or size > last["sizes"][0] * CLASS_RATIO:
            classes.append(last := {"width": width, "sizes": [], "names": [], "sets": []})
        for key, value in (("sizes", size), ("names", name), ("sets", own)):
            last[key].append(value)
    for c in classes:
        c["window"] = max(c["sizes"])
        c["bands"] = bands_for(c["sizes"], c["window"], share)
        c["minima"] = [np.array([K.mix(s ^ _salt(b)).min() for s in c["sets"]], dtype=U) for b in range(c["bands"])]
    return classes


def _salt(band: int) -> np.uint64:
    return U((band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, shorter at the end."""
    out, have, width = x.copy(), 1, min(width, len(x))
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _found_long(c: dict, grams: np.ndarray, at: np.ndarray, hits: np.ndarray) -> set[tuple[int, int]]:
    """(document, template) that meet in a band, for documents with as many of the class's shingles as its least share needs."""
    own = hits[np.isin(grams[hits], c["union"])]
    held = np.bincount(np.searchsorted(at, own, "right") - 1, minlength=len(at))
    found = set()
    for d in np.flatnonzero(held >= c["need"]):
        mine = grams[at[d] : max(at[d], at[d + 1] - c["width"] + 1)]
        for band in range(c["bands"] if len(mine) else 0):
            least = sliding_min(K.mix(mine ^ _salt(band)), c["window"])
            found.update((int(d), int(t)) for t in np.flatnonzero(np.isin(c["minima"][band], least)))
    return found


def _scan(templates: dict[str, str], k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = template_classes(templates, k, num / den)
        for c in classes:
            c["need"] = min(-(-num * s // den) for s in c["sizes"])
            c["union"] = np.unique(np.concatenate(c["sets"]))
        long = [c for c in classes if c["sizes"][0] > LONG]
        every = np.unique(np.concatenate([c["union"] for c in long])) if long else np.zeros(0, dtype=U)
        likely = np.zeros(1 << 20, dtype=bool)
        likely[(every >> U(44)).astype(np.int64)] = True
        for batch in batches:
            for part in K.passes(batch, "text"):
                hashes, starts, _, at = K.words(*K.buffers(part.column(1)))
                out = []
                hits = None  # places of shingles of long classes, all of k words
                for c in classes:
                    grams = K.shingle_at(hashes, c["width"])
                    if not len(grams):
                        continue
                    found = set()
                    if c["sizes"][0] > LONG:
                        if hits is None:
                            hits = np.flatnonzero(likely[(grams >> U(44)).astype(np.int64)])
                            hits = hits[np.isin(grams[hits], every)]
                        found = _found_long(c, grams, at, hits)
                    for band in range(0 if c["sizes"][0] > LONG else c["bands"]):
                        least = sliding_min(K.mix(grams ^ _salt(band)), c["window"])
                        few = np.zeros(1 << 16, dtype=bool)
                        few[(c["minima"][band] >> U(48)).astype(np.int64)] = True
                        for p in np.flatnonzero(few[(least >> U(48)).astype(np.int64)]):
                            for t in np.flatnonzero(c["minima"][band] == least[p]):
                                # a window reaches over the end of a document at most into the next one
                                first = int(np.searchsorted(at, p, "right")) - 1
                                last = int(np.searchsorted(at, min(p + c["window"], at[-1]) - 1, "right")) - 1
                                found.update((d, int(t)) for d in range(first, last + 1))
                    for d, t in sorted(found):
                        own = grams[at[d] : max(at[d], at[d + 1] - c["width"] + 1)]
                        where = np.flatnonzero(np.isin(own, c["sets"][t]))
                        both = len(np.unique(own[where]))
                        if both and den * both >= num * c["sizes"][t]:
                            out.append((d, c["names"][t], c["sizes"][t], both, int(where[0])))
                if out:
                    doc, name, size, both, word = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc, pa.int64())), pa.array(name), pa.array(size, pa.int64()), pa.array(both, pa.int64()), pa.array(word, pa.int64())], ["doc_id", "template", "n_template_shingles", "n_shared", "first_word"])

    return run


def _blocks(templates: DataFrame, name_col: str, text_col: str) -> Iterator[dict[str, str]]:
    """A table of templates in parts of about TEMPLATE_BYTES, measured first; each part is what a task is given at a time."""
    table = templates.select(F.col(f"`{name_col}`").cast("string").alias("name"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where("name is not null")
    size = table.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = -(-size // TEMPLATE_BYTES)
    for i in range(parts):
        rows = table.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == i).collect()  # TEMPLATE_BYTES, about
        held = {}
        for r in rows:
            if held.setdefault(r["name"], r["text"]) != r["text"]:
                raise ValueError(f"two templates are named {r['name']!r}")
        yield held


def license_matches(docs: DataFrame, *, templates: dict[str, str] | DataFrame | None = None, shingle_words: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", name_col: str = "name", template_col: str = "text") -> DataFrame:
    """Templates of whose word shingles a document holds the share (an exact ratio) or more.

    Returns doc_id, template, n_template_shingles, n_shared, containment, first_word (place of the first shared
    shingle), a row for each match in each row of ``docs``.  ``templates`` is name -> text (TEMPLATES and whole_texts()
    unless given), or a table of names and texts of any size: it goes to the tasks in measured parts, and the documents
    are read once for each part.  The bands promise to retrieve a template whose share stands in one window, in any
    order; containment is judged in the whole document, so a share that is scattered over many windows is reported
    when one of them retrieves it, without a promise.  A template of fewer than ``shingle_words`` words is one shingle
    of its words; one without words or name matches nothing, nor do null and blank texts.  Repeated rows give
    repeated matches, a null id stays null, further columns are ignored, an empty table on either side gives no rows.
    """
    num, den = share
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    parts = list(_blocks(templates, name_col, template_col)) if isinstance(templates, DataFrame) else [TEMPLATES | whole_texts() if templates is None else templates]
    schema = "doc_id long, template string, n_template_shingles long, n_shared long, first_word long"
    found = reduce(DataFrame.unionByName, [rows.mapInArrow(_scan(p, shingle_words, num, den), schema) for p in parts or [{}]])
    return found.withColumn("containment", F.col("n_shared") / F.col("n_template_shingles"))
