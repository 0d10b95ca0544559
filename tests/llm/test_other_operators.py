"""WARC, chat formatting, licence scan, components and the pipeline."""

import base64
import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import chat, license_scan, warc
from riskloom.llm import queries as q
from riskloom.llm.common import prepare
from riskloom.llm.components import components

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return prepare(spark).read.parquet(f"{SF}/{name}.parquet")


# ------------------------------------------------------------------------------------------------------------ WARC
def archived(pages):
    groups = collections.defaultdict(list)
    for page_id, html in pages:
        groups[(html or "").encode()].append(page_id)
    out = []
    for page_id, html in pages:
        data = (html or "").encode()
        first = min((x for x in groups[data] if x is not None), default=None)
        copy = page_id != first
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if copy else "response", first if copy else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    pages = [(r.page_id, r.html) for r in table(spark, "pages").collect()]
    assert sorted((tuple(r) for r in q.op4_warc(spark, SF).collect()), key=str) == archived(pages)


def test_warc_of_awkward_rows(spark):
    rows = [(1, "http://a/\r\nb", "x"), (2, None, None), (3, "u", ""), (4, "u", "é" * 5000), (4, "u", "é" * 5000), (5, "u", "x"), (None, "u", "x"), (None, None, "\r\n\r\n")]
    pages = prepare(spark).createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, length int")
    index, records = warc.archive_and_read(pages)
    got = sorted((tuple(r) for r in records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == archived([(a, c) for a, _, c in rows])
    assert index.where("length > 0 and digest is not null").count() == len(rows)
    assert warc.archive_and_read(pages.where("1 = 0"))[1].count() == 0


def test_small_payloads_are_no_revisits_and_ranges_join(spark):
    pages = prepare(spark).createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    assert {r.page_id for r in warc.archive_and_read(pages, min_bytes=3)[1].where("record_type = 'revisit'").collect()} == {4}
    assert warc.ranges([(0, 10), (10, 5), (40, 10), (45, 3), (500, 900)], gap=25, most=100) == [(0, 4, 50), (4, 5, 900)]


def test_selected_records_hold_their_payload(spark):
    pages = table(spark, "pages")
    folder = "file://" + warc.scratch_path(spark, "warc").removeprefix("file:").replace("//", "/")
    index = warc.write_archives(pages, folder, file_bytes=20_000)
    assert index.select("file").distinct().count() > 1
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_records(index.where("page_id % 7 = 0"), folder).where("payload is not null").collect()}
    want = {r.page_id: r.html for r in pages.where("page_id % 7 = 0").collect()}
    assert got and all(want[k] == v for k, v in got.items())


# ------------------------------------------------------------------------------------------------------------ chat
def rendered(turns):
    by = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn is None, turn or 0, (role or "unknown").replace("|", "_").replace(" ", "_"), text or ""))
    out = {}
    for conv, rows in by.items():
        rows.sort()
        for who in {r[2] for r in rows}:
            text, spans = "", []
            for _, _, name, body in rows:
                text += "<|assistant|>\n" if name == who else f"<|user:{name}|>\n"
                if name == who:
                    spans.append((len(text), len(text) + len(body) + len("<|end|>")))
                text += body + "<|end|>\n"
            out[conv, who] = text, spans
    return out


def joined(rows):
    parts = collections.defaultdict(list)
    for r in rows:
        parts[r.conv_id, r.perspective].append(r)
    out = {}
    for key, x in parts.items():
        x.sort(key=lambda r: r.part)
        at = 0
        for r in x:
            assert r.starts_at == at
            at += len(r.rendered)
        out[key] = "".join(r.rendered for r in x), [(s["from"], s["to"]) for r in x for s in r["mask"]]
    return out


@pytest.mark.parametrize("part_turns", [3, 256])
def test_every_perspective_of_every_dialogue(spark, part_turns):
    turns = table(spark, "conversations")
    want = rendered([(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()])
    assert joined(chat.rotate(turns, part_turns).collect()) == want


def test_chat_of_awkward_rows(spark):
    rows = [(1, 0, "a|b c", "hi"), (1, 1, None, None), (1, 1, None, None), (1, None, "z", ""), (None, 0, "a", "é🙂"), (2, 5, "only", "x" * 50_000)]
    rows += [(3, i, f"p{i % 5}", f"turn {i}") for i in range(700)]
    turns = prepare(spark).createDataFrame([(*r, 1, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int, place int")
    assert joined(chat.rotate(turns).collect()) == rendered(rows)
    assert chat.rotate(turns.where("1 = 0")).count() == 0


# -------------------------------------------------------------------------------------------------------- licences
def test_licences_are_found_and_inherited(spark):
    rows = [
        ("LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/LICENSE.txt", "Some words.\nReleased under the MIT License.\n"), ("a/b/c/x.py", "nothing here"),
        ("a/b/c/y.py", "# This work is licensed under the GNU General Public License, version 3."), ("d/z.py", None), ("d/z.py", ""), ("e/COPYING", "no licence named, only license words"),
        ("e/f.txt", "released version work under the"), (None, "Released under the MIT License."), ("a/NOTICE", "All rights reserved."),
    ]
    files = prepare(spark).createDataFrame([(*r, 1) for r in rows], "path string, text string, depth int")
    own = license_scan.scan(files)
    assert {r.path: r.license for r in own.collect() if r.path} == {"LICENSE": "Apache-2.0", "a/LICENSE.txt": "MIT", "a/b/c/y.py": "GPL-3.0"}
    got = {(r.path, r.license, r.inherited_license, r.inherited_from) for r in license_scan.inherit(files, own).collect()}
    assert ("a/b/c/x.py", None, "MIT", "a") in got and ("d/z.py", None, "Apache-2.0", "") in got
    assert ("a/b/c/y.py", "GPL-3.0", None, None) in got and ("e/f.txt", None, "Apache-2.0", "") in got and (None, None, None, None) in got
    none = files.where("1 = 0")
    assert license_scan.inherit(none, license_scan.scan(none)).count() == 0


def test_licence_lines_of_the_documents(spark):
    rows = q.op8_license_scan(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    lines = {"MIT": "released under the mit license.", "Apache-2.0": "licensed under the apache license, version 2.0.", "GPL-3.0": "this work is licensed under the gnu general public license, version 3."}
    for r in rows:
        named = {k for k, v in lines.items() if v in texts[r.doc_id].lower().split("\n")}
        assert not named or r.license in named
    assert any(r.inherited_license for r in rows)


def test_licence_scores_equal_a_plain_computation(spark):
    files = table(spark, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    more = [("x", "Released under the MIT License, says the author.\nreleased released MIT license"), ("y", "the terms of the Mozilla Public License, version 2.0 hold"), ("y", "zzz"), ("z", None)]
    files = files.union(spark.createDataFrame(more, "path string, text string"))
    lines = [(r.path, set(license_scan.terms(x))) for r in files.collect() for x in (r.text or "").split("\n") if r.text is not None]
    seen = collections.Counter(t for _, bag in lines for t in bag)
    idf = lambda t: math.log((1 + len(lines)) / (1 + seen[t])) + 1
    norm = lambda bag: math.sqrt(sum(idf(t) ** 2 for t in bag))
    templates = {n: set(license_scan.terms(x)) for n, x in sorted(license_scan.TEMPLATES.items())}
    want = {}
    for path, bag in lines:
        for name, other in templates.items():
            score = round(sum(idf(t) ** 2 for t in bag & other) / (norm(bag) * norm(other)), 9) if bag else 0
            if score >= license_scan.THRESHOLD and score > want.get(path, ("", 0))[1]:
                want[path] = name, score
    got = {r.path: (r.license, r.score) for r in license_scan.scan(files).collect()}
    assert "x" in got and len(got) > 3 and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-9 for k in want)


LICENCE_LINES = {
    "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
}


def test_every_licence_wording_of_the_table_is_found(spark):
    folder = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    found = {r.doc_id: r.license for r in q.op8_license_scan(spark, folder).collect()}
    seen = collections.Counter()
    for doc_id, text in texts.items():
        lines = [x for x in text.split("\n") if re.search(r"(?i)licen[cs]e|rights reserved", x)]
        assert all(x in LICENCE_LINES for x in lines)
        names = {LICENCE_LINES[x] for x in lines}
        assert found[doc_id] in (names - {"Proprietary"} or names) if names else found[doc_id] is None
        seen.update(lines)
    assert seen.keys() == LICENCE_LINES.keys() and sum(seen.values()) == 328


def test_licence_texts_over_several_lines_and_bare_reservations(spark):
    reserved = "Copyright (c) 2021 Somebody Inc. All rights reserved."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
    clause = "3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software"
    rows = [
        ("mit", mit), ("bsd2", f"{reserved}\n\n{bsd}"), ("bsd3", f"{reserved}\n\n{bsd}{clause}"), ("own", f"words\n{reserved}\nwords"), ("bare", "All rights reserved."),
        ("sa", "Licensed under CC BY-SA 3.0."), ("none", "all of the rights that the people have\nreserved seats"), ("both", "All rights reserved.\nReleased under the MIT License."),
    ]
    files = prepare(spark).createDataFrame([*rows, *((f"x{i}", "plain words of the text\nand others in it") for i in range(50))], "path string, text string")
    got = {r.path: r.license for r in license_scan.scan(files, license_scan.FORMS, window=license_scan.WINDOW).collect()}
    assert got == {"mit": "MIT", "bsd2": "BSD-2-Clause", "bsd3": "BSD-3-Clause", "own": "Proprietary", "bare": "Proprietary", "sa": "CC-BY-SA-3.0", "both": "MIT"}


def test_inheritance_equals_a_walk_up_the_tree(spark):
    rows = q.op8_license_scan(spark, "/root/testdata/sf0.01").collect()
    speaking = collections.defaultdict(list)
    for r in rows:
        directory, _, name = r.path.rpartition("/")
        if r.license and name.startswith("LICENSE"):
            speaking[directory].append((-r.score, r.license))
    for r in rows:
        at = r.path
        found = None
        while at and not found and not r.license:
            at = at.rpartition("/")[0]
            if at in speaking:
                found = (min(speaking[at])[1], at)
        assert (r.inherited_license, r.inherited_from) == (found or (None, None))


# ------------------------------------------------------------------------------------------ components, pipeline
def test_components(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("q", "q"), ("e", "d"), ("m1", "hub"), ("m2", "hub"), ("m3", "hub"), ("m3", "x")]
    got = {r.node: r.root for r in components(prepare(spark).createDataFrame(edges, "s string, t string"), "s", "t").collect()}
    assert got == {**dict.fromkeys("abcde", "a"), **dict.fromkeys(["hub", "m1", "m2", "m3", "x", "y"], "hub"), "q": "q"}


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(q.materialise(stage(spark, seen[-1], SF)))
    counts = [d.count() for d in seen]
    assert counts[-1] == counts[-2] and sorted(counts, reverse=True) == counts and counts[3] < counts[2] and counts[4] < counts[3]
    assert all(d.schema == docs.schema for d in seen[1:5])
    clean = q.op1_decontamination(spark, SF).where("contaminated").select("doc_id")
    assert seen[4].join(clean, "doc_id").count() == 0
    assert seen[4].select(F.count("*"), F.countDistinct("doc_id")).first()[0] == seen[4].select("doc_id").distinct().count()


def test_pipeline_of_an_empty_table(spark):
    docs = table(spark, "documents").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
