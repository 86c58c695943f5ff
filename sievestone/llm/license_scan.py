"""License scan with a generalised suffix automaton over licence tokens.

The automaton of all templates and phrases is built once (its size depends on the
templates alone) and broadcast. A text's words stream through it: at every word it knows
the longest run ending there that occurs in some template (matching statistics). A phrase
stands where the state's run ends with the whole phrase. Long runs are chained per
template, in template order and within a bounded gap, into covered spans: one for every
copy of a template that reaches `least_cover`, which gives its label, else the best one.

Words: A-Z lowered, runs of digits, a-z and characters beyond ASCII.

Defined results: null or empty text has no words, no labels, null positions and score 0;
repeated rows and ids are scanned each by itself; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, text_bytes, texts

#: Phrases that give a label wherever they stand.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages of well-known licences and notices, by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "proprietary": "All rights reserved.",
}
#: Shortest run (words) that counts towards a span, widest gap between chained runs, and the coverage that gives a label.
LEAST_RUN, WIDEST_GAP, LEAST_COVER = 3, 12, 0.6

_TABLE = bytes(c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class Automaton:
    """Generalised suffix automaton of token sequences."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, token: int) -> int:
        q = self.step[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.step[p]:
            self.step[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def add(self, words: list[bytes]) -> list[int]:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        last = 0
        for token in ids:
            last = self.extend(last, token)
        return ids

    def walk(self, ids: list[int]) -> int:
        state = 0
        for token in ids:
            state = self.step[state][token]
        return state


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str], least_run: int, widest_gap: int, least_cover: float):
        self.least_run, self.widest_gap, self.least_cover = least_run, widest_gap, least_cover
        self.machine = machine = Automaton()
        self.phrases = [(label, machine.add(words_of(text.encode()))) for text, label in sorted(phrases.items())]
        self.templates = [(label, machine.add(words_of(text.encode()))) for label, text in sorted(templates.items())]
        # the phrases that end every run of a state: those of its suffix links' states too
        own: dict[int, list[int]] = {}
        for k, (_, ids) in enumerate(self.phrases):
            own.setdefault(machine.walk(ids), []).append(k)
        self.ending: list[tuple[int, ...]] = [()] * len(machine.length)
        for state in sorted(range(len(machine.length)), key=machine.length.__getitem__):
            if state:
                self.ending[state] = (*own.get(state, ()), *self.ending[machine.link[state]])
        # where the templates' runs lie: positions after each state's end, per template
        self.where: list[dict[int, list[int]]] = [{} for _ in machine.length]
        for t, (_, ids) in enumerate(self.templates):
            state = 0
            for i, token in enumerate(ids):
                state, at = machine.step[state][token], i + 1
                s = state
                while s > 0:
                    self.where[s].setdefault(t, []).append(at)
                    s = machine.link[s]

    def matches(self, words: list[bytes]):
        """Phrase places (start, phrase) and maximal runs (start, length, state)."""
        machine = self.machine
        step, link, length, ending = machine.step, machine.link, machine.length, self.ending
        get, phrases, least = machine.vocabulary.get, self.phrases, self.least_run
        places, runs = [], []
        state = run = 0
        for i, token in enumerate(map(get, words)):
            if token is None:
                if run:
                    if run >= least:
                        runs.append((i - run, run, state))
                    state = run = 0
                continue
            go = step[state].get(token)
            if go is None:
                if run >= least:
                    runs.append((i - run, run, state))
                while go is None and state:
                    state = link[state]
                    run = length[state]
                    go = step[state].get(token)
                if go is None:
                    run = 0
                    continue
            state, run = go, run + 1
            for k in ending[state]:
                size = len(phrases[k][1])
                if size <= run:
                    places.append((i + 1 - size, k))
        if run >= least:
            runs.append((len(words) - run, run, state))
        return places, runs

    def spans(self, runs) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, coverage) of every chain that reaches `least_cover`, or of the template's best one if none does."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for start, size, state in runs:
            for t, ends in self.where[state].items():
                for at in ends:
                    by_template.setdefault(t, []).append((start, size, at - size))
        out = []
        for t, hits in by_template.items():
            total = len(self.templates[t][1])
            best: dict[int, tuple[int, int, int]] = {}  # by its first word, the chain's widest: covered, first, end
            chains: list[tuple[int, int, int, int]] = []  # in reach: covered, first, end in the text, end in the template
            for start, size, at in sorted(hits):
                covered, first = 0, start
                chains = [c for c in chains if c[2] + self.widest_gap >= start]
                for c in chains:
                    if c[2] <= start <= c[2] + self.widest_gap and c[3] <= at <= c[3] + self.widest_gap and c[0] > covered:
                        covered, first = c[0], c[1]
                chains.append((covered + size, first, start + size, at + size))
                if first not in best or chains[-1][0] > best[first][0]:
                    best[first] = (chains[-1][0], first, start + size)
            taken: list[tuple[int, int]] = []
            for covered, first, end in sorted(best.values(), key=lambda c: (-c[0], c[1])):
                if taken and covered < self.least_cover * total:
                    break
                if all(end <= x or first >= y for x, y in taken):
                    taken.append((first, end))
                    out.append((self.templates[t][0], first, end, min(1.0, covered / total)))
        return sorted(out)


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, least_run: int = LEAST_RUN, widest_gap: int = WIDEST_GAP, least_cover: float = LEAST_COVER) -> DataFrame:
    """One row per row of docs: id, n_words, places (phrase label, first word, end), spans (label, first word, end, coverage)."""
    sent = docs.sparkSession.sparkContext.broadcast((PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates, least_run, widest_gap, least_cover))
    made: list[Scanner] = []
    place = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Scanner(*sent.value))
        scanner, sizes, all_places, all_spans = made[0], [], [], []
        for text in texts(batch.column(1)):
            words = words_of(text)
            sizes.append(len(words))
            places, runs = scanner.matches(words)
            all_places.append([(scanner.phrases[k][0], at, at + len(scanner.phrases[k][1])) for at, k in places])
            all_spans.append(scanner.spans(runs) if runs else [])
        return pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array([[dict(zip(("label", "first", "end"), x, strict=True)) for x in p] for p in all_places], pa.list_(place)), pa.array([[dict(zip(("label", "first", "end", "coverage"), x, strict=True)) for x in p] for p in all_spans], pa.list_(span))], ["id", "n_words", "places", "spans"])

    return map_rows(docs, [F.col(id_col).alias("id"), text_bytes(text_col).alias("text")], work, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, places array<struct<label:string,first:long,end:long>>, spans array<struct<label:string,first:long,end:long,coverage:double>>")


def labelled(scanned: DataFrame, least_cover: float = LEAST_COVER) -> DataFrame:
    """scan()'s rows with their labels and score."""
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.transform("places", lambda x: x["label"])
    long = F.filter("spans", lambda x: x["coverage"] >= least_cover)
    return scanned.select(
        "id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(F.transform("places", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["first"])).alias("last_word"), names(base).alias("base_labels"),
        names(F.concat(base, F.transform(long, lambda x: x["label"]))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0))).alias("score"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return labelled(scan(docs)).withColumnRenamed("id", "doc_id")
