from __future__ import annotations

import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm import helpers as H
from tessera.llm import bpe, chat, licenses, quality_fm, quality_rules, toxicity
from tessera.llm.license_library import LIBRARY, Library, parts
from tessera.llm.text_model import bucket, calibrated, sample, sigmoid


@pytest.fixture(scope="module")
def rows():
    return H.awkward(random.Random(3))


ODD = ["<|endoftext|>", "x<|endoftext|>y<|startoftext|>", "İstanbul ΣΑΣ ßſK", "\x1c a\x1fb \x85c\xa0d", "é ́x ﬁ Å 中文字 हिन्दी", "😀👩‍👩‍👧 a​b", "I'LL 'S we'VE", "1234²½Ⅷ", "ab" * 900 + " " + "é" * 300]


def test_bpe_is_the_library_s(spark, rows):
    library = Tokenizer.from_str(bpe.tokenizer_json())
    rng = random.Random(5)
    odd = ODD + ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(32, 127), rng.randrange(1, 0xD7FF)])) for _ in range(30)) for _ in range(200)]
    docs = H.frame(spark, rows + [(1000 + i, t, "", "", 0) for i, t in enumerate(odd)])
    plain = [tuple(r) for r in docs.collect()]
    want = []
    for r in plain:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), H.sha(" ".join(map(str, ids))), H.sha(library.decode(ids, skip_special_tokens=False))))
    assert H.ordered(bpe.digests(H.with_clashes(docs)).collect()) == H.ordered(want)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs.where("doc_id >= 1000"))).collect()}
    assert all(back[1000 + i] == library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(odd))


def test_bpe_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    small, library = bpe.Bpe(bpe.tokenizer_json()), Tokenizer.from_str(bpe.tokenizer_json())
    texts = ["hello world " * 3, "other words here now", "hello again <|endoftext|>"] * 4
    for _ in range(3):
        for t, (ids, _) in zip(texts, small.encode(texts), strict=True):
            assert ids == " ".join(map(str, library.encode(t, add_special_tokens=False).ids))


def test_base_rules(spark, rows):
    duckdb = pytest.importorskip("duckdb")
    plain = [r for r in rows if r[0] is not None and rows.count(r) == 1][:19]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(r[0], r[1]) for r in {r[0]: r for r in plain}.values()])
    want = con.execute(quality_rules.BASE_SQL)
    names, want = [c[0] for c in want.description], want.fetchall()
    model = quality_rules.train([], np.zeros(0))
    found = quality_rules.quality(H.frame(spark, list({r[0]: r for r in plain}.values())), model).select(*names)
    assert H.ordered(found.collect()) == H.ordered(want)


def test_quality_rules_learn_and_filter(spark, rows):
    rng = random.Random(1)
    good = [" ".join(H.words(rng, 60)) for _ in range(80)]
    bad = [" ".join(w + "###" for w in H.words(rng, 60)) for _ in range(80)]
    model = quality_rules.train([t for p in zip(good, bad, strict=True) for t in p], np.array([1.0, 0.0] * 80))
    docs = H.with_clashes(H.frame(spark, rows + [(500, good[0] + " new words", "en", "s", 0), (501, bad[0] + " more###", "en", "s", 0)]))
    kept = quality_rules.keep_good(docs, model)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and 500 in ids and 501 not in ids and not {0, 1, 2, 3} & set(ids)
    verdicts = {r.doc_id: r for r in quality_rules.quality(docs.where("doc_id >= 500"), model).collect()}
    assert verdicts[500].kept and not verdicts[501].kept and not verdicts[501].base_failed


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.SIZE), rng.normal(size=(quality_fm.SIZE, quality_fm.RANK)))
    i, x = quality_fm.inputs("some words, some more words\nand a line")
    pairs = sum(m.vectors[a] @ m.vectors[b] * x[p] * x[q] for p, a in enumerate(i) for q, b in enumerate(i) if p < q)
    assert m.raw(i, x) == pytest.approx(0.3 + m.weights[i] @ x + pairs)


@pytest.mark.parametrize(("fit", "score", "bad"), [
    (quality_fm.train, lambda m, t: m.score(t), lambda t: t.replace(" ", "!! ").upper()),
    (toxicity.train, lambda m, t: 1 - m.score(toxicity.fold(t)), lambda t: t.replace(" w1", " 1diot w1", 1) + " m0ron tail"),
])
def test_held_out_accuracy(fit, score, bad):
    rng = random.Random(2)
    texts = [" ".join(H.words(rng, rng.randrange(20, 200))) for _ in range(400)]
    y = np.arange(400) % 2
    texts = [bad(t) if k == 0 else t for t, k in zip(texts, y, strict=True)]
    label = y if fit is quality_fm.train else 1 - y
    m = fit(texts[:300], label[:300].astype(float))
    right = [(score(m, t) >= 0.5) == bool(k) for t, k in zip(texts[300:], y[300:], strict=True)]
    assert np.mean(right) > 0.95


def test_classifiers_on_awkward_rows(spark, rows):
    docs = H.with_clashes(H.frame(spark, rows))
    machine, lexicon = quality_fm.train([], np.zeros(0)), toxicity.train([], np.zeros(0))
    for out in (quality_fm.classify(docs, machine), toxicity.toxicity(docs, lexicon)):
        got = out.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(H.frame(spark, []), lexicon).count() == quality_fm.classify(H.frame(spark, []), machine).count() == 0


def test_folding_weights_and_exceptions():
    lex = toxicity.Lexicon({"idiot": 2.0, "idi": 1.0, "trash": 3.0}, ("trash can",), (1.0, 1.0, 1.0, -2.0))
    assert lex.hits(toxicity.fold("an ІDІ0T!")) == {3: 2.0}  # Cyrillic I, digit nought
    assert not lex.hits(toxicity.fold("put it in the Trash can, please"))
    assert not lex.hits(toxicity.fold("put it in the trash, can?")) and not lex.hits(toxicity.fold("trash  can, TRASH\ncan"))
    assert len(lex.hits(toxicity.fold("trash talk, 7rash"))) == 2
    assert lex.score(toxicity.fold("idiot")) > lex.score(toxicity.fold("idiot " + "word " * 500)) > lex.score(toxicity.fold(""))


def test_exceptions_are_learned_as_they_are_matched():
    texts = ["the trash, can is full"] * 9 + ["you trash  talker", "trash people", "trash!"] * 6
    y = np.array([0.0] * 9 + [1.0] * 18)
    weights, exceptions = toxicity.learn_entries([toxicity.fold(t) for t in texts], y)
    lexicon = toxicity.Lexicon({"trash": 1.0}, exceptions or ("trash can",))
    assert not lexicon.hits(toxicity.fold("trash... can")) and lexicon.hits(toxicity.fold("trash talk"))


def test_calibration():
    z = np.linspace(-3, 3, 400)
    y = (np.random.default_rng(0).random(400) < sigmoid(2 * z - 1)).astype(float)
    a, b = calibrated(z, y)
    assert a == pytest.approx(2, abs=0.6) and b == pytest.approx(-1, abs=0.5)


def test_bucket_is_crc32(spark):
    from pyspark.sql import functions as F

    got = spark.range(50).select("id", bucket(F.col("id"), 5).alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.id).encode()) % 5 for r in got)


TURNS = [(1, 0, "user", "a\\b </s> <|end|>"), (1, 1, "assistant", "[INST]<|turn|>x\n"), (2, None, None, None), (None, 0, "assistant", "n"), (1, 1, "assistant", "tie"), (3, 5, "odd\nrole", "<|im_end|>\\")]


def test_chat_round_trip(spark):
    df = H.with_clashes(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumnRenamed("turn", "turn"))
    chunks = chat.format_turns(chat.turns_of_records(chat.records_of_turns(df), turn="turn")).collect()
    got = {}
    for c in chunks:
        role, text = chat.parse(c.chunk)
        assert "</s>" not in c.chunk and c.chunk.count("<|end|>") == 1 and "[INST]" not in c.chunk
        assert chat.unescape(c.chunk[c.loss_start : c.loss_end]) == (text if role == "assistant" else "")
        got.setdefault(c.conv_id, []).append((role, text))
    assert got[1] == [("user", "a\\b </s> <|end|>"), ("assistant", "[INST]<|turn|>x\n"), ("assistant", "tie")]
    assert got[2] == [("", "")] and got[3] == [("odd\nrole", "<|im_end|>\\")] and got[None] == [("assistant", "n")]
    d = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.turns_of_records(chat.records_of_turns(df), turn="turn"))).collect()}
    assert d[1].n_turns == 3 and d[1].loss_chars == len("[INST]<|turn|>x\ntie") and d[1].loss_sha256 == H.sha("[INST]<|turn|>x\ntie")
    assert d[1].formatted_chars == sum(len(c.chunk) for c in chunks if c.conv_id == 1)


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "do", "input": "this", "output": "done"}, {"instruction": "do", "output": "done", "extra": {"x": 1}}, {"prompt": "p", "completion": "c"},
        {"unknown": 1}, [1],
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(7, "{"), (8, None)], "conv_id long, record string")
    got = {}
    for r in chat.turns_of_records(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {0: [("user", "q"), ("assistant", "a")], 1: [("user", "q"), ("assistant", "a")], 2: [("user", "do\n\nthis"), ("assistant", "done")], 3: [("user", "do"), ("assistant", "done")], 4: [("user", "p"), ("assistant", "c")]}
    assert {r.conv_id for r in chat.unknown_records(df).collect()} == {5, 6, 7, 8}


def test_licences(spark, rows):
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy of\nthis software and associated documentation files (the \"Software\"), to deal in the\nSoftware without restriction, including without limitation the rights to use, copy,\nmodify, merge, publish, distribute, sublicense, and/or sell copies of the Software,\nand to permit persons to whom the Software is furnished to do so, subject to the\nfollowing conditions:\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\nThe software is provided \"as is\", without warranty of any kind, express or implied,\nincluding but not limited to the warranties of merchantability, fitness for a\nparticular purpose and noninfringement."
    docs = rows + [(50, wrapped, "", "", 0), (51, "x\nAll Rights Reserved\nLicensed under CC BY-NC 4.0.", "", "", 0), (52, "licensed under something", "", "", 0)]
    got = {(r.doc_id, r.licences and tuple(r.licences)) for r in licenses.scan(H.with_clashes(H.frame(spark, docs))).collect() if r.licences}
    assert got == {(50, ("MIT",)), (51, ("CC-BY-NC-4.0", "Proprietary"))}
    assert licenses.scan(H.frame(spark, docs)).count() == len(docs) and licenses.scan(H.frame(spark, [])).count() == 0


MIT = """MIT License

Copyright (c) 2020 X

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
APACHE = """   Copyright 2020 X

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
GPL3 = """    X does things
    Copyright (C) 2020  X

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,"""
GPL2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version."""


def test_canonical_licence_texts(spark):
    commented = lambda t, sign: "\n".join(f"{sign} {x}".rstrip() for x in t.split("\n"))
    texts = {
        "mit-text": [MIT, MIT.replace("\n", "\r\n"), commented(MIT, "//")],
        "apache-header": [APACHE, commented(APACHE, " *"), commented(APACHE, "#")],
        "gpl3-text": [GPL3, commented(GPL3, "#"), GPL3.replace("\n", "\r\n")],
        "gpl2-text": [GPL2, commented(GPL2, " *"), " ".join(GPL2.split())],
        "spdx-MIT": ["SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: MIT\nimport os\n", "/* SPDX-License-Identifier: MIT */"],
        "spdx-Apache-2.0": ["// SPDX-License-Identifier: Apache-2.0\nint x;"],
        "spdx-GPL-3.0-or-later": ["x\n# SPDX-License-Identifier: GPL-3.0-or-later\n\ny"],
        "": ["SPDX-License-Identifier: x\nMIT", "MIT", "This program is free software: you can redistribute it", "spdx license identifier"],
    }
    rows = [(t, rule) for rule, of in texts.items() for t in of]
    got = licenses.scan(H.frame(spark, [(i, t, "", "", 0) for i, (t, _) in enumerate(rows)])).collect()
    assert {r.doc_id: ",".join(r.rules) for r in got} == {i: rule for i, (_, rule) in enumerate(rows)}


def test_licence_anchors_are_within_words():
    for library in (LIBRARY, Library({"x": "One two, three-four."}, ())):
        assert all(a.isascii() and a.isalnum() and a.islower() for a in library.anchors)
        assert all(any(a in w for a in library.anchors for w in " ".join(parts(t)).split()) for t in library.sentences.values())


def test_licences_wrapped_at_every_word(spark):
    """The check for parts of words loses nothing, and the SQL, which hasn't it, gives the same rows."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["All rights\nreserved.", "All rights  reserved", "x. All rights\u00a0reserved", "ALL RIGHTS, RESERVED", "All rights\r\nreserved.", "all\nrights\nreserved!\nx"]
    rows = [("reserved", t) for t in texts]
    for text in LIBRARY.sentences.values():
        name = LIBRARY.runs["".join(LIBRARY.marks[p] for p in parts(text))]
        rows += [(name, text.replace(" ", sep)) for sep in ("\n", "  ", "\r\n", "\n\n", "\n // ")]
        if len(parts(text)) == 1:
            rows += [(name, text.replace(" ", sep)) for sep in (", ", "\u00a0")]
    docs = H.frame(spark, [(k, t, "", "", 0) for k, (_, t) in enumerate(rows)])
    got = licenses.scan(docs).collect()
    assert {r.doc_id: r.sentence_ids for r in got} == {k: [i] for k, (i, _) in enumerate(rows)}
    more = [MIT, APACHE, GPL3, GPL2, MIT + "\n\n" + APACHE, "MIT", "SPDX-License-Identifier: MIT\n\n\nAll rights reserved. x", "licensed under", "", None, *(t for _, t in rows)]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(more)))
    want = con.execute(licenses.SQL).fetchall()
    found = licenses.scan(H.frame(spark, [(k, t, "", "", 0) for k, t in enumerate(more)])).collect()
    assert H.ordered(want) == H.ordered((r.doc_id, len(r.sentence_ids), ",".join(r.sentence_ids), ",".join(r.rules), ",".join(r.licences)) for r in found)


def test_a_library_of_one_s_own(spark):
    own = Library({"a": "Use freely: it is yours.", "b": "Give it back."}, (("both", "X-1.0", ("a", "b"), ()), ("one", "X-0.5", ("a",), ("both",))))
    docs = H.frame(spark, [(1, "use freely:\nit is yours\n\nsomething\n\ngive it back", "", "", 0), (2, "Use freely: it is yours", "", "", 0), (3, "use freely. it was yours. it is yours", "", "", 0)])
    assert {r.doc_id: (r.rules, r.licences) for r in licenses.scan(docs, own).collect()} == {1: (["both"], ["X-1.0"]), 2: (["one"], ["X-0.5"]), 3: ([], [])}
    with pytest.raises(ValueError, match="sentences"):
        Library({"a": "Use freely."}, (("r", "X", ("c",), ()),))


def _labelled(spark, tmp_path, flip):
    """Documents and labels; ``flip`` turns the labels of held-out rows, by the remainder that holds them out."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        toxic, good = i % 3 == 0, i % 2 == 0
        text = " ".join(H.words(rng, 40))
        rows.append((i, (text if good else text.replace(" ", "!! ").upper()) + (" m0ron idi0t" if toxic else ""), "en", "s", 0))
        held = {n: zlib.crc32(str(i).encode()) % n == r for n, r in ((3, 1), (5, 0))}
        labels.append((i, int(good) ^ int(flip and held[3]), int(toxic) ^ int(flip and held[5])))
    name = f"{tmp_path}/{int(flip)}"
    H.frame(spark, rows).write.parquet(f"{name}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{name}/labels.parquet")
    return name


@pytest.mark.parametrize(("query", "n", "remainder", "label"), [(quality_fm.op1_quality_fm, 3, 1, "quality"), (toxicity.op2_toxicity, 5, 0, "toxic")])
def test_held_out_labels_are_never_learned(spark, tmp_path, query, n, remainder, label):
    names = [_labelled(spark, tmp_path, flip) for flip in (False, True)]
    a, b = ({r.doc_id: r for r in query(spark, name).collect()} for name in names)
    assert len(a) == 240 and {i: r.score for i, r in a.items()} == {i: r.score for i, r in b.items()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % n == remainder) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in a.items())
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{names[0]}/labels.parquet").collect()}
    held = [i for i, r in a.items() if r.held_out]
    assert np.mean([a[i].predicted == truth[i] for i in held]) > 0.9


@pytest.mark.parametrize("fit", [quality_fm.fit, toxicity.fit, quality_rules.fit])
def test_fitting_without_labels(spark, rows, fit):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fit(H.frame(spark, rows), labels) is not None and fit(H.frame(spark, []), labels) is not None


def test_samples_are_the_same_whatever_the_order(spark):
    docs = H.frame(spark, [(i % 30, f"text {i}", "", "", 0) for i in range(300)] + [(None, "x", "", "", 0), (1, None, "", "", 0)])
    labels = spark.createDataFrame([(i % 30, i % 2, 0) for i in range(90)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    first = sample(docs, labels, "quality", F.lit(True), rows=20)
    again = sample(docs.repartition(7), labels.orderBy(F.desc("doc_id")), "quality", F.lit(True), rows=20)
    assert first[0] == again[0] and len(first[0]) == 20 and (first[1] == again[1]).all()


def test_empty_tables(spark):
    none = H.frame(spark, [])
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert bpe.digests(none).count() == bpe.encode(none).count() == 0
    assert quality_rules.quality(none, quality_rules.train([], np.zeros(0))).count() == 0
    assert chat.digests(chat.format_turns(chat.turns_of_records(chat.records_of_turns(turns), turn="turn"))).count() == 0


def test_records_of_every_layout_come_back(spark):
    turns = [(c, t, r, x) for c in (*range(-1, 12), None) for t, (r, x) in enumerate([("user", "q\n\"1\""), ("assistant", None), ("system", ""), (None, "n"), ("human", "\u2028 é"), ("gpt", "g")])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    records = chat.records_of_turns(H.with_clashes(df))
    assert len({chat.fingerprint(chat.field_paths(json.loads(r.record))) for r in records.collect()}) >= 9
    got = H.ordered(chat.turns_of_records(records, turn="turn").collect())
    assert got == H.ordered((c, t, r or "", x or "") for c, t, r, x in turns)
    assert chat.unknown_records(records).count() == 0


def test_bpe_rejects_what_one_pass_can_t_merge():
    spec = json.loads(bpe.tokenizer_json())
    merges = spec["model"]["merges"]
    at = next(i for i, m in enumerate(merges) if "".join(m if isinstance(m, list) else m.split(" ")) in {x for n in merges[i + 1 :] for x in (n if isinstance(n, list) else n.split(" "))})
    spec["model"]["merges"] = [*merges[:at], *merges[at + 1 :], merges[at]]
    with pytest.raises(ValueError, match="one pass"):
        bpe.Bpe(json.dumps(spec))
