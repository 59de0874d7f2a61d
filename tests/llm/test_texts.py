"""Pairs, sentences, leaks and packing."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from netquarry.llm import contamination as L
from netquarry.llm import packing as K
from netquarry.llm import pairs as P
from netquarry.llm import sentences as S


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("What ports does x_top have?", None, "empty"), ("Q?", " \n", "empty"), ("Q?", "<answer></answer>", "empty"), ("Q?", "**Answer:** n/a", "empty"), ("Q?", "```\n```", "empty"), (None, "​", "empty"),
        ("What ports does x_top have?", "You asked: what ports does `x_top` have", "copied_question"), ("Nenne die Ports.", "Nenne die Ports. Nenne die Ports.", "copied_question"),
        ("What is it?", "I'm sorry, but I can't help with that.", "refusal"), ("Warum?", "Leider darf ich dazu keine Auskunft geben.", "refusal"), ("なぜですか？", "申し訳ありませんが、お答えできません。", "refusal"), ("¿Qué es?", "Por desgracia, no puedo responder a esta pregunta.", "refusal"),
        ("What registers does module x_y have?", "Das Register a_b wird von clk getrieben und nur einmal gelesen.", "other_language"), ("为什么？有风险吗？", "El registro recibe la señal y se lee solo una vez.", "other_language"), ("¿Por qué es arriesgado?", "寄存器只在上升沿读取。", "other_language"),
        ("List the ports of x_y.", "Module x_y has 3 ports: a_b, c_d", "truncated"), ("What is it?", "The register a_b is driven by", "truncated"), ("What?", "It is set.\n```tcl\nset_load", "truncated"), ("What?", "It is fast. The arbiter cannot gr", "truncated"), ("有哪些端口？", "模块x_y有3个端口：a、b", "truncated"), ("What?", "a_b, c_d and", "truncated"),
        ("List the ports of x_y.", "Module x_y has 2 ports: a_b, c_d", None), ("What?", "Yes.", None), ("How many?", "12", None), ("Which?", "a_b, c_d and e_f", None), ("Which?", "none of the listed blocks", None),
        ("Why is x_y risky?", "Why is x_y risky? It has many parents.", None), ("What is it?", "Unfortunately the path has only 3.1 ns of slack left.", None), ("What?", "The arbiter cannot grant two masters at once.", None), ("What?", "It is set.\n```tcl\nset_load 1\n```", None), ("有哪些端口？", "模块x_y有2个端口：a、b", None), (None, "It is fine.", None),
    ],
)
def test_defects(question, answer, defect):
    assert (P.defects(question, answer) or [None])[0] == defect


def test_defects_of_tables(spark):
    rows = [(1, None, None, "z"), (1, None, None, "z"), (2, "Q?", "Yes.", "z"), (3, "Q?", "word " * 20_000 + "end.", "z")]
    df = spark.createDataFrame(rows, "pair_id bigint, question string, answer string, defects string")
    assert [tuple(r) for r in P.first_defects(df).collect()] == [(1, "empty")]
    assert P.first_defects(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "parts",
    [
        ["It costs 3.5 V, e.g. in x_y.", " See Fig. 3 and Dr. Klein.", " Done!"],
        ["mosi is set.", " clk_core feeds 3 registers.", " It ended at 5 p.m.", " Then a.m. came again."],
        ['He said "Stop. Now!" and left.', " (It works. Really.)", " Next."],
        ["Nobody knows why... the trace stops.", " Is it 3.1 V?", " We use approx. 29.8 V.", " The end."],
        ["Laut Dr. Klein gilt es bis zum 3. Takt, z. B. am 3. Mai.", " Ja."],
        ["« Trop tôt. Deux fois », a dit M. Petit.", " C'est ça !", " Voir p. ex. la fig. 3."],
        ["¿Por qué?", " ¡No edites x_y!", " Según el Sr. Paz, etc. queda."],
        ["См. рис. 9 и т. д. уже.", " По словам г. Петрова, да!"],
        ["他说：“太早。两次。”然后离开。", "为什么？", "必须……否则不行。"],
        ["動作は安定（詳細を見ること。）が低い。", "「まず確認！」という注意。"],
        ["डॉ. शर्मा आए।", " क्यों?", " ठीक है।"],
        ["قال د. علي نعم.", " لماذا؟", " حسنا."],
        ["ไฟล์ x_y ถูกแก้ไขแล้ว", " ค่าเผื่อของ z ลดลง", " ทำไม"],
        ["# A heading. Still one", "\n\nText goes\non here.", "\n\n- item one. ", "More of it", "\n- item two", "\n\n```v\na. B\n\nc\n```", "\nAfter."],
        ["1. First item", "\n2. Second one.", "\n\nEs gilt bis zum\n41. Takt hier."],
        ["﻿Start.", "\r\n\r\nEnd"],
        ["It fails at the slow corner.", "Is 3.1 V enough (see a_b.sdc).", "H. Klein says no.", "WHEN IT RAN in 9.41 V.", "Why not?", "¿Por qué?"],
        ["See Rev. Smith, Gen. Lee and Lt. Col. Brown.", " The file sub.name or np.Array(x) stays whole."],
        ["frob[3:0] is wide.", " frob toggles."],
        ["ພາສາລາວ", " ອັກສອນລາວ"],
    ],
)
def test_units(parts):
    text, at, want = "".join(parts), 0, []
    for p in parts:
        lead = len(p) - len(p.lstrip(" \r\n﻿"))
        want.append((at + lead, at + len(p.rstrip())))
        at += len(p)
    assert S.units(text) == want


def test_units_cover_everything_once():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", ".", "!", " ", "\n", '"', "(", ")", "。", "「", "」", "```", "- ", "1. ", "ก", "😀", "\t"]) for _ in range(40))
        spans = S.units(text)
        assert all(s < e for s, e in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        inside = "".join(text[s:e] for s, e in spans)
        assert "".join(inside.split()) == "".join(text.split())
    assert S.units(None) == S.units("") == S.units(" \n﻿ ") == []


WORDS = "the quick arbiter in block forty drops sixteen beats of data when nevik shifts ninety words into the queue before dawn".split()


def noisy(rng, words, every):
    out = []
    for k, w in enumerate(words, 1):
        if k % every == 0:
            out.extend(rng.choice([["other"], [w[1:] + "x"], [], [w, "extra"]]))
        else:
            out.append(w)
    return out


def test_leaks_found_and_phrases_not(spark):
    rng = random.Random(4)
    filler = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    item = " ".join(WORDS)
    docs = [
        (1, " ".join(filler(300) + WORDS[2:16] + filler(900))),
        (2, " ".join(filler(30) + [w.upper() + "," for w in WORDS] + filler(30))),
        (3, " ".join(filler(50) + WORDS[4:12] + filler(50))),
        (4, " ".join(filler(40) + noisy(rng, WORDS, 5) + filler(40))),
        (5, item.replace("a", "а").replace("arbiter", "ar​biter")),
        (6, " ".join(w if k % 3 else "zz" for k, w in enumerate(WORDS))),
        (7, None), (8, ""), (9, " ".join(filler(20_000))),
        (10, " ".join(WORDS[:11])),
    ]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(7, item), (7, "short one"), (8, None), (9, "x " * 5), (10, " ".join(filler(40)))], "item_id bigint, text string")
    got = {tuple(r) for r in L.find_leaks(d, i).collect()}
    assert got == {(1, 7), (2, 7), (4, 7), (5, 7)}
    assert {tuple(r) for r in L.find_leaks(d, i, in_task=0).collect()} == got
    for bits in (8, 16):  # a full filter lets everything through to the join
        assert {tuple(r) for r in L._joined(d.where("text is not null").select("doc_id", "text"), L._item_texts(i), bits).collect()} == got
    assert L.find_leaks(d.limit(0), i).count() == 0 and L.find_leaks(d, i.limit(0)).count() == 0


def test_alignment_equals_trying_every_run():
    rng = random.Random(6)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(60):
        item = [f"t{k}" for k in range(14)]
        doc = [f"r{k}" for k in range(3)] + noisy(rng, item, rng.choice([3, 5, 6])) + ["q"]
        some = any(edits(item[a:b], doc[c:d]) * 5 <= b - a for a in range(3) for b in range(a + 12, 15) for c in range(len(doc)) for d in range(c + 9, len(doc) + 1) if item[a] == doc[c] and item[b - 1] == doc[d - 1])
        assert (L.longest_run(item, doc) >= 12) == some


def test_windows_fall_into_partitions_by_size():
    assert [L.slots_for(s) for s in L.SIZES] == sorted(L.slots_for(s) for s in L.SIZES) and L.slots_for(L.SIZES[0]) < L.SLOTS
    for n in (1, 7, 8, 16, 17, 31, 32, 33, 48, 49, 500, L.SEGMENT - 1, L.SEGMENT, L.SEGMENT + 1, L.SEGMENT + 40, 2 * L.SEGMENT + 5):
        begins = sorted(b for at, minima in L.window_minima(np.arange(n, dtype=np.uint64)) for b in at.tolist())
        assert begins[0] == 0 and len(set(begins)) == len(begins)
        for run in range(max(1, n - L.REACH + 1)):  # every stretch as long as a run lies within a window
            assert any(b <= run and min(n, run + L.REACH) <= b + 2 * L.HALF for b in (run // L.HALF * L.HALF, run // L.HALF * L.HALF - L.HALF) if b in set(begins)) or n <= 2 * L.HALF
            if n > 2000 and run > 100:
                break


def test_words_ignore_notation():
    assert L.words("The <b>rx_Data_5</b> got 12,345.50 — not 91 422!") == L.words("the rxData5 got 12345.50 not 91422")
    assert L.words("") == []


def test_packing_by_queues():
    rng = random.Random(1)
    items = [(k, 0, min(2048, int(rng.lognormvariate(5, 1.2))), rng.choice("aaab")) for k in range(3000)] + [(3001, 0, 0, "b")]
    total = sum(x[2] for x in items)
    share = {s: sum(x[2] for x in items if x[3] == s) / total for s in "ab"}
    out = list(K.pack(items, share, {}))
    assert sorted(x[0] for x in out) == sorted(x[0] for x in items)
    room, source, held = {}, {x[0]: x[3] for x in items}, {}
    for doc, _, size, container, offset in out:
        assert room.get(container, 0) == offset
        room[container] = offset + max(1, size)
        held[container] = held.get(container, 0) + size * (source[doc] == "a")
    assert max(room.values()) <= 2048 and total / (2048 * len(room)) > 0.97
    # neither sizes nor shares drift along the run
    n = len(room)
    thirds = [[abs(held[k] / room[k] - share["a"]) for k in room if k * 3 // n == t] for t in range(3)]
    means = [sum(t) / len(t) for t in thirds]
    assert max(means) - min(means) < 0.05
    sizes = [[x[2] for x in out if x[3] * 3 // n == t] for t in range(3)]
    means = [sum(t) / len(t) for t in sizes]
    assert max(means) < 1.3 * min(means)
    # a text is at most as far behind the oldest of its source as is in sight
    for s in "ab":
        places = {x[0]: k for k, x in enumerate(i for i in items if i[3] == s)}
        done, oldest = set(), 0
        for doc, *_ in (x for x in out if source[x[0]] == s):
            assert places[doc] < oldest + K.LOOK + sum(1 for p in done if p >= oldest)
            done.add(places[doc])
            while oldest in done:
                oldest += 1


def test_whole_pieces_are_charged_to_their_source():
    items = [(1, p, 2048, "a") for p in range(10)] + [(100 + k, 0, 512, "b") for k in range(40)]
    out = list(K.pack(items, {"a": 0.5, "b": 0.5}, {}))
    first = [x for x in out if x[3] < 10]
    assert 4 <= sum(1 for x in first if x[0] == 1) <= 6 and len({x[3] for x in out}) == 20


@pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary file")
def test_packing_of_tables(spark):
    rows = [(k, ("word %d " % k) * (k % 50 + 1), None if k % 7 == 0 else f"s{k % 3}", "x") for k in range(200)]
    rows += [(500, None, "s1", "x"), (501, "", "s1", "x"), (502, "many different words " * 3000, "s2", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, container_id string")
    for kw in ({}, {"per_partition": 40}, {"shares": {"s1": 3.0, "s2": 1.0}}):
        got = K.pack_texts(df, capacity=256, **kw).collect()
        assert {r.doc_id for r in got} == {r[0] for r in rows} - {500}
        filled = {}
        for r in got:
            filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
        assert max(filled.values()) <= 256
        long = sorted(((r.piece_no, r.start_token, r.n_tokens) for r in got if r.doc_id == 502))
        assert all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:])) and all(x[2] == 256 for x in long[:-1])
    assert K.pack_texts(df.limit(0)).count() == 0
    stats = K.deviations(K.pack_texts(df, capacity=256), df).collect()
    assert {r.third for r in stats} == {0, 1, 2} and all(0.5 < r.filled <= 1 and 0 <= r.deviation < 0.5 for r in stats)
    assert K.deviations(K.pack_texts(df.limit(0)), df).count() == 0


def test_open_brackets_quotes_and_backticks_are_truncated():
    for text in ("uart_tx (8 bits", "The port is `uart_tx", "It has flags (e.g.", "He says “it is", 'It prints "done', "reg [7:0", "端口（八位"):
        assert P.is_truncated("What is it?", text), text
    for text in ("uart_tx (8 bits)", "The range is [0, 5).", "a) first one.\nb) second one.", "The port is `uart_tx`.", "Use `define X 1.", "Er sagt „ja“.", 'It is 5" wide.', "```\nx[\n```"):
        assert not P.is_truncated("What is it?", text), text
    assert not P.is_open("Fine :)")


def test_scripts_and_words_of_many_languages():
    for answer in ("Регистр читается только по фронту.", "Il registro viene letto solo sul fronte di salita e non cambia.", "Het register wordt alleen gelezen op de stijgende flank.", "寄存器由clk_core驱动，只在上升沿读取。", "レジスタは立ち上がりでのみ読まれます。", "يقرأ السجل عند الحافة فقط."):
        assert P.defects("Why is it risky to change the module x_y?", answer) == ["other_language"], answer
    assert P.defects("モジュールx_yのポートは何ですか？", "模块x_y有2个端口：a_b、c_d") == ["other_language"]
    assert P.defects("Почему это опасно?", "Регистр clk_core читается только по фронту.") == []
    assert P.defects("为什么？", "x_y has 3 ports: a_b, c_d, e_f") == []  # too few letters outside code to tell


def test_profiles_tell_what_function_words_do_not(spark):
    rows = [(k, f"{a} {n}_{k} {b}?", "") for k in range(400) for n, a, b in (("m", "Which ports does the module", "have in the design"), ("n", "Quels ports possède le module", "et dans la puce"))]
    df = spark.createDataFrame(rows, "pair_id bigint, question string, answer string")
    profiles = P.fit_profiles(df)
    assert set(profiles.model) == {"en", "fr"}
    q = "Quels ports possède le module x_y ?"
    assert P.defects(q, "Module x_y has ports: a_b, c_d.", profiles) == ["other_language"] and P.defects(q, "Module x_y has ports: a_b, c_d.") == []
    assert P.defects(q, "Le module x_y possède ports : a_b, c_d.", profiles) == []
    assert not P.fit_profiles(df.limit(0)).model


def test_profiles_count_every_question(spark):
    common = spark.range(40_000).selectExpr("id AS pair_id", "concat('Which ports does the module m_', id, ' have in the design?') AS question", "'' AS answer")
    rare = spark.range(60).selectExpr("id", "concat('Quels ports possède le module n_', id, ' et dans la puce?')", "''")
    profiles = P.fit_profiles(common.union(rare).union(rare).union(spark.range(5).selectExpr("id", "null", "''")))
    assert set(profiles.model) == {"en", "fr"}
    counts = {lang: {g: n * of for g, n in Counter(P._trigrams(P.prose(q))).items()} for lang, of, q in (("en", 40_000, "Which ports does the module m_1 have in the design?"), ("fr", 60, "Quels ports possède le module n_1 et dans la puce?"))}
    assert profiles.model == P.Profiles(counts, 40_060).model
    q = "Quels ports possède le module x_y ?"
    assert P.defects(q, "Module x_y has ports: a_b, c_d.", profiles) == ["other_language"]
    assert P.defects(q, "Le module x_y possède ports : a_b, c_d.", profiles) == []


def test_larger_tables_of_the_same_texts_give_the_same_language():
    texts = {"en": "Which ports does the module have in the design?", "fr": "Quels ports possède le module et dans la puce?"}
    counts = {lang: Counter({g: n * 1_000 for g, n in Counter(P._trigrams(t)).items()}) for lang, t in texts.items()}
    few, many = (P.Profiles({lang: {g: n * k for g, n in c.items()} for lang, c in counts.items()}, 20_000 * k) for k in (1, 1_000))
    for plain in ("Le module possède ports mosi, miso, rdata", "Module has ports mosi, wdata, scl", "qwz xkj vvb zzq"):
        (a, lead), (b, other) = few.language(plain), many.language(plain)
        assert a == b and lead == pytest.approx(other), plain


def test_every_defect_is_told():
    assert P.defects("Nenne die Ports von x_y", "Nenne die Ports von x_y") == ["copied_question", "truncated"]
    assert P.defects("Why is the module x_y risky?", "Leider darf ich dazu keine Auskunft geben, weil das Modul nicht") == ["refusal", "other_language", "truncated"]
