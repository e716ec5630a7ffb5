import random

from quireline.llm import license_scan as L
from quireline.llm import queries


def judged(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS hits", "'y' AS p")
    return {r.doc_id: r for r in L.scan(df).collect()}


def test_notices_have_cues_and_are_found(spark):
    texts = [(f, t) for f, own in L.NOTICES.items() for t in own]
    got = judged(spark, [t for _, t in texts])
    for i, (family, text) in enumerate(texts):
        assert [h.family for h in got[i].hits if h.family != L.UNKNOWN] in ([family], [family] * 2), text


def test_held_out_wordings(spark):
    texts = {
        "The code is released under the MIT License": "mit",
        "Licensed under the Apache License Version 2.0 by the authors": "apache",
        "Some text here. This work is licensed under the GNU General Public License, version 2.": "gpl",
        "Photos licensed under CC BY-NC 4.0": "cc-by-nc",
    }
    got = judged(spark, list(texts))
    assert [[h.family for h in got[i].hits] for i in range(len(texts))] == [[f] for f in texts.values()]


def test_look_alikes_are_unknown(spark):
    got = judged(spark, L.OTHERS + ["A license to thrill: the new bond film opens in May", "permission permission warranty", "Licence fees rose again this year, said the operator of the ferry."])
    assert all(h.family == L.UNKNOWN for r in got.values() for h in r.hits)


def test_edge_cases(spark):
    got = judged(spark, [None, "", " \n \n", "Released under the MIT License.\nReleased under the MIT License.", "word " * 200_000 + "\nLicensed under CC BY 4.0.", "x " * 300 + ". Licensed under the Apache License, Version 2.0. " + "y " * 300, "(c)"])
    assert [(got[i].n_paragraphs, len(got[i].hits)) for i in range(3)] == [(0, 0)] * 3
    assert [h.family for h in got[3].hits] == ["mit", "mit"]
    assert [h.family for h in got[4].hits] == ["cc-by"]
    assert [h.family for h in got[5].hits] == ["apache"]
    assert [h.family for h in got[6].hits] == [L.UNKNOWN]
    assert L.report(L.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_projection_equals_plain_python(spark, sf):
    model, rng = L.fitted(), random.Random(1)
    pool = [w for own in [*L.NOTICES.values(), L.OTHERS] for t in own for w in t.split()]
    texts = ["license " + " ".join(rng.choices(pool, k=rng.randrange(0, 30))) for _ in range(200)]
    for i, r in judged(spark, texts).items():
        family, probability, contained = model.judge(texts[i])
        if len(texts[i]) <= L.LONG:
            (hit,) = r.hits
            assert hit.family == family and abs(hit.probability - probability) < 1e-9 and abs(hit.contained - contained) < 1e-9


def test_probabilities_are_calibrated():
    assert 0.05 < L.fitted().temperature <= 3 and 0.5 <= L.fitted().least < 1


def test_query_is_native_and_has_a_row_for_each_document(spark, sf):
    df = queries.op2_license_scan(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Exchange"))
    rows = {r.doc_id: r for r in df.collect()}
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    assert rows.keys() == texts.keys()
    for notice, family in (("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under the Apache License, Version 2.0.", "apache")):
        assert all(family in rows[i].families.split(",") for i, t in texts.items() if notice in t.split("\n"))


def test_report_equals_plain_python_over_documents(spark, sf):
    model = L.fitted()
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    got = {r.doc_id: r.families for r in queries.op2_license_scan(spark, sf).collect()}
    want = {i: ",".join(sorted(model.families_in(t))) for i, t in texts.items()}
    assert got == want and len({w for w in want.values() if w}) >= 4
    # what was planted are whole lines; recall and precision by document
    planted = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache"}
    truth = {(i, planted[line]) for i, t in texts.items() for line in t.split("\n") if line in planted}
    found = {(i, f) for i, own in got.items() if own for f in own.split(",")}
    assert truth and len(truth & found) >= 0.98 * len(truth) and len(truth & found) >= 0.98 * len(found)


def test_other_licences_are_unknown(spark):
    texts = ["Eclipse Public License v1.0", "The Artistic License", "Released under the zlib license.", "SPDX-License-Identifier: EUPL-1.2", "Licensed under the Open Software License 3.0", "Distributed under the Eclipse Distribution License", "Licensed under the Boost Software License 1.0", "Released under the ISC license", "Available under the Open Database License 1.0", "Licensed under the SIL Open Font License"]
    assert all(h.family == L.UNKNOWN for r in judged(spark, texts).values() for h in r.hits)


def test_wrapped_notices(spark):
    texts = [
        "/* Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated documentation files\n * (the Software), to deal in the Software without restriction. */\n\nOther text",
        "Some words before. This work is licensed under the GNU General\nPublic License,\nversion 3. And some after.",
        "Released under\n\nthe MIT bridge. License plates were sold there.",
        "Released under the MIT License.\nReleased under the MIT License.",
        "ends here\nReleased under the\nMIT License",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = L.report(L.scan(df)).orderBy("doc_id").collect()
    assert [r.families for r in rows] == ["mit", "gpl", "", "mit", "mit"]
    assert rows[3].n_licensed == 2
    assert [",".join(sorted(L.fitted().families_in(t))) for t in texts] == [r.families for r in rows]


def test_kept_columns_of_any_name(spark):
    names = ["hits", "n_paragraphs", "families", "p", "cued", "own", "over", "sure", "doc_id", "__k0"]
    df = spark.sql("SELECT 'Released under the MIT License.' AS text, " + ", ".join(f"{i} AS `{n}`" for i, n in enumerate(names)))
    found = L.scan(df, keep=tuple(names))
    assert found.columns == ["hits_kept", "n_paragraphs_kept", *names[2:], "n_paragraphs", "hits"]
    row = L.report(found, keep=("hits_kept", *names[2:])).first()
    assert (row.hits_kept, row.families_kept, row.families, row.n_licensed, row.own) == (0, 2, "mit", 1, 5)


def test_notices_inside_prose(spark):
    prose = "The old mill by the river was built of red brick and has kept its wooden wheel until this very day, they say"
    texts = {
        f"{prose}. Released under the MIT License.": ["mit"],
        f"{prose}. Released under the MIT License. {prose}. Photos licensed under CC BY-NC 4.0.": ["cc-by-nc", "mit"],
        f"SPDX-License-Identifier: Zlib. {prose}.": [],
        "The prisoner was released under the terms of the agreement with the license office.": [],
        f"{prose}, released under the MIT License, and {prose}.": ["mit"],
        f"{prose}. {prose}. {prose}. {prose}. SPDX-License-Identifier: MIT": ["mit"],
        f"{prose}. {prose}. {prose}. {prose}. He lost his driving licence after the accident in March.": [],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.families for r in L.report(L.scan(df)).collect()}
    assert [got[i] for i in range(len(texts))] == [",".join(f) for f in texts.values()]


def test_lines_without_cue_words_are_judged(spark):
    model = L.fitted()
    texts = ["Released under GPLv3", "Released under CC0 1.0.", "Distributed under the terms of the AGPLv3.", "SPDX: none.\nReleased under GPLv3 or later", "The mill was built of red brick. It is distributed under the terms of the AGPLv3."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.families for r in L.report(L.scan(df)).orderBy("doc_id").collect()] == ["gpl", "public-domain", "agpl", "gpl", "agpl"]
    assert not any(L.re.search(L.CUE, texts[i]) for i in (0, 1, 2, 4))
    # without a cue word, a line is listed exactly if its sentences are confirmed
    rng = random.Random(2)
    pool = [w for own in [*L.NOTICES.values(), L.OTHERS] for t in own for w in t.split() if not L.re.search(L.CUE, w)]
    texts = [t for t in (" ".join(rng.choices(pool, k=rng.randrange(1, 12))) for _ in range(400)) if not L.re.search(L.CUE, t)]
    for i, r in judged(spark, texts).items():
        assert [h.family for h in r.hits] == [f for f in [model.judge(texts[i])[0]] if f != L.UNKNOWN], texts[i]


def test_pairs_of_all_sentences_are_looked_up(spark):
    docs = spark.createDataFrame([(1, "This file is under the\nMIT License. Nothing else.\n")], "doc_id long, text string")
    scanned = L.scan(docs)
    plan = scanned._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and plan.count("arrays_overlap") == 1  # the one left is for sentences that are judged
    assert L.fitted().families_in(docs.first().text) == {r.family for r in scanned.first().hits} - {L.UNKNOWN}
