import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from kinetra.llm.encode import VOCABULARIES, VOCABULARY, Encoder, token_count, token_ids, vocabulary
from kinetra.llm.mixing import mixed, pfair_slots, quotas, reached_shares, segment_units
from kinetra.llm.nearest_time import nearest_in_time
from kinetra.llm.personal_info import candidates, personal_spans, plain, redacted

PATH = f"{VOCABULARIES}/{VOCABULARY}"


# ---- nearest time ----


def brute_nearest(left, right, tolerance):
    out = []
    for i, k, t in {x for x in left if None not in x and x[2] == x[2]}:
        near = [(abs(u - t), u, j) for j, q, u in right if q == k and None not in (j, q, u) and abs(u - t) <= tolerance]
        if near:
            out.append((i, min(near)[2]))
    return sorted(out)


@pytest.mark.parametrize("group_rows", [1, 50, 100_000])
def test_nearest_against_brute_force(spark, group_rows):
    r = random.Random(group_rows)
    left = [(i, r.choice("aab"), r.uniform(-4000, 4000)) for i in range(80)] + [(1000, None, 1.0), (1001, "a", None), (1002, "a", float("nan")), (None, "a", 3.0), (1003, "c", 0.0)]
    right = [(i, r.choice("aab"), float(r.randrange(-4000, 4000))) for i in range(300)] + [(None, "a", 5.0), (900, None, 5.0)]
    right += right[:20]
    ls, rs = spark.createDataFrame(left + left[:9], "id bigint, k string, t double").withColumn("key", F.lit("clash")), spark.createDataFrame(right, "rid bigint, k string, u double").withColumn("t", F.lit(1))
    got = nearest_in_time(ls, rs, ["k"], "id", "t", "rid", "u", 5.0, group_rows)
    assert sorted(map(tuple, got.select("id", "rid").collect())) == brute_nearest(left, right, 5.0)


def test_nearest_ties_and_empty(spark):
    ls = spark.createDataFrame([(1, "a", 10.0)], "id bigint, k string, t double")
    rs = spark.createDataFrame([(7, "a", 11.0), (9, "a", 9.0), (8, "a", 9.0), (5, "a", 200.0)], "rid bigint, k string, u double")
    assert rows(nearest_in_time(ls, rs, ["k"], "id", "t", "rid", "u", 5.0)) == [(1, 8, 1.0)]
    assert nearest_in_time(ls.limit(0), rs, ["k"], "id", "t", "rid", "u", 5.0).count() == 0
    assert nearest_in_time(ls, rs.limit(0), ["k"], "id", "t", "rid", "u", 5.0).count() == 0


# ---- encoding ----


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("ab ", max_size=80) | st.text("日本語のテスト'll 12", max_size=40), max_size=8))
def test_encoding_is_that_of_the_library(public, texts):
    assert Encoder(PATH).encode(texts) == public(texts)


def test_encoding_of_hard_texts(public):
    texts = ["", " ", "<|endoftext|>", "a" * 30_000, "日本" * 5_000, " \t\n  x ", "🦴🩻 é é ﷺ", "don't WE'LL", "\x00\x01", " " * 9_000 + "x"]
    assert Encoder(PATH).encode(texts) == public(texts)


def test_pairs_against_merging():
    v, r = vocabulary(PATH), random.Random(3)
    inverse = {i: w for w, i in v.rank.items()}
    pairs = [(r.randrange(v.n), r.randrange(3000)) for _ in range(20_000)]
    import numpy as np

    good = v.compatible(*map(np.array, zip(*pairs)))
    assert all(g == (v._merged(inverse[a] + inverse[b]) == [a, b]) for g, (a, b) in zip(good, pairs))


def test_encoding_columns(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "x" * 3_000_000)], "id int, text string").withColumn("ids", F.lit("clash"))
    got = {r.id: (list(r.i), r.n) for r in df.where("id < 4").select("id", token_ids(F.col("text")).alias("i"), token_count(F.col("text")).alias("n")).collect()}
    assert got == {1: ([31373, 995], 2), 2: ([], 0), 3: ([], 0)}
    assert df.where("id = 4").select(token_count(F.col("text"))).first()[0] > 1000
    assert df.limit(0).select(token_ids(F.col("text"))).count() == 0


# ---- mixing ----


def test_quotas():
    assert quotas(100, [1, 1, 2], [1e9] * 3) == [25, 25, 50]
    assert quotas(100, [1, 1, 2], [10, 1e9, 1e9]) == [10, pytest.approx(30), pytest.approx(60)]
    assert quotas(100, [1, 0, 2], [10, 1e9, 20]) == [10, 0, 20]
    assert quotas(100, [0, 0], [10, 10]) == [0, 0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=6).filter(sum), st.sampled_from([1, 7, 50, 10_000]))
def test_no_source_is_a_block_off(units, length):
    """Units are half blocks: less than two units off at any time, less than one where a single segment holds all."""
    n, t, done = sum(units), 0, [0] * len(units)
    for part in segment_units(units, length):
        slots = pfair_slots(part)
        assert len(slots) == sum(part) == min(length, n - t) and min(part) >= 0
        for s, _ in slots:
            t += 1
            done[s] += 1
            off = max(abs(d - u * t / n) for d, u in zip(done, units))
            assert off < (1 if length >= n else 2)
        assert max(abs(d - u * t / n) for d, u in zip(done, units)) < 1
    assert done == units


def test_ten_million_blocks_are_as_exact_as_few():
    units = [1, 13, 20_000_000 // 3, 5_000_001, 777, 8_333_000]
    n, t, done = sum(units), 0, [0] * len(units)
    for k, part in enumerate(segment_units(units)):
        slots = pfair_slots(part) if k % 97 == 0 else None
        now = list(done)
        for i, (s, _) in enumerate(slots or [], 1):
            now[s] += 1
            if i % 501 == 0:
                assert all(abs(d - u * (t + i) / n) < 2 for d, u in zip(now, units))
        t, done = t + sum(part), [a + b for a, b in zip(done, part)]
        assert all(abs(d - u * t / n) < 1 for d, u in zip(done, units))
    assert done == units


def test_mix(spark):
    r = random.Random(2)
    docs = [(i, "big" if i % 3 else "small", r.randrange(1, 60)) for i in range(600)] + [(700, None, 100), (701, "big", 0)]
    targets = [("m", " Big", 0.25, 1, 0.5), ("m", "SMALL ", 0.25, 3, 0.5), ("m", "absent", 0.25, 3, 0.5), ("m", "never", 0.0, 9, 0.5), ("all", "small", 1.0, 2, 9.0), ("n", None, 1.0, 1, 1.0), (None, "big", 1.0, 1, 1.0)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").withColumn("quota", F.lit(1)).withColumn("slot", F.lit(1))
    t = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int, size_ratio double")
    got = mixed(sized, t, block_tokens=50).collect()
    total = sum(d[2] for d in docs)
    m = [x for x in got if x.mix_name == "m"]
    assert {x.mix_name for x in got} == {"m", "all"}
    for s in ("big", "small"):
        assert abs(sum(x.n_tokens for x in m if x.source == s) - total / 4) <= 30
    small = [d for d in docs if d[1] == "small"]
    assert len([x for x in got if x.mix_name == "all"]) == 2 * len(small)
    assert all(x.copy_no <= {"big": 1, "small": 3}[x.source] for x in m) and len({(x.doc_id, x.copy_no) for x in m}) == len(m)
    # along the interleaved order both sources advance together
    done = {"big": 0, "small": 0}
    for x in sorted(m, key=lambda x: (x.slot, x.start_token)):
        done[x.source] += x.n_tokens
        assert abs(done["big"] - done["small"]) < 50 * 2 + 120
    shares = {(x.mix_name, x.source): x for x in reached_shares(mixed(sized, t, 50), sized, t).collect()}
    assert shares["m", "big"].share == pytest.approx(0.5, abs=0.02) and shares["m", "absent"].tokens == 0 and shares["m", "big"].target_share == pytest.approx(1 / 3)
    assert sorted(map(tuple, mixed(sized, t, 50, 7).drop("slot").collect()), key=repr) == sorted(map(tuple, mixed(sized, t, 50).drop("slot").collect()), key=repr)
    assert mixed(sized.limit(0), t).count() == 0 and mixed(sized, t.limit(0)).count() == 0


# ---- personal information ----

NAMES = [(a, b) for a in ("Corva", "Jorun", "Ysolt", "Fenja") for b in ("Belquist", "Fosdwick", "Tresquist")]


def corpus():
    r, out = random.Random(1), []
    for k in range(240):
        a, b = r.choice(NAMES)
        parts = [
            f"Patient: {a} {b} (second visit).", f"Send the file to {a.lower()}.{b.lower()}@lab{k % 7}.example.org by noon.", f"Recorded by {b}, {a}.", f"Tel. +44 1632 960 {r.randrange(100, 999)}",
            f"Tel. 01632 960{r.randrange(100, 999)}", f"National ID 9{r.randrange(10, 99)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)} was shown.", f"National ID QZ{r.randrange(1000000, 9999999)} was shown.",
            f"Home address: {r.randrange(1, 99)} Mill Street, Ostbury.", f"Home address: Zum Alten Mill {r.randrange(1, 99)}.", f"Serial plate: SN {r.randrange(1000, 9999)}-{r.randrange(100, 999)}-{r.randrange(10, 99)}.",
            f"Epoch 18{r.randrange(10**10, 10**11)} maps to 2028-01-10.", "The Tarnwick grid is fixed with Ostbury tape @ 7 N.", "Rain On The Roof was loud.",
        ]
        out.append((k, "🦴 " + " ".join(r.sample(parts, 6))))
    return out


def test_personal_information(spark):
    docs = corpus()
    bare = "Fosdwick, Jorun – 01632 960777 – QZ1234567 – Zum Alten Mill 7 – SN 1234-567-89"
    docs += [(9000, bare), (9001, None), (9002, ""), (9003, "y @ lab [dot] example [dot] org " + "x" * 200_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("group", F.lit("clash")).withColumn("spans", F.lit(1))
    spans = personal_spans(df)
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in spans.collect()}
    text = dict(docs)
    said = {d: [(k, text[d][a:b]) for k, a, b in s] for d, s in got.items()}
    assert said[9000] == [("name", "Fosdwick, Jorun"), ("phone", "01632 960777"), ("id_number", "QZ1234567"), ("address", "Zum Alten Mill 7")]
    assert said[9003] == [("email", "y @ lab [dot] example [dot] org")] and 9001 not in got and 9002 not in got
    want = wrong = 0
    for d, t in docs[:240]:
        kinds = [k for k, _ in said.get(d, [])]
        expected = [k for k, mark in (("name", "Patient:"), ("name", "Recorded"), ("email", "@lab"), ("phone", "Tel. +"), ("phone", "Tel. 0"), ("id_number", "ID 9"), ("id_number", "ID Q"), ("address", "Mill Street"), ("address", "Zum Alten")) if mark in t]
        want += len(expected)
        wrong += sorted(kinds) != sorted(expected)
    assert want > 600 and wrong == 0
    clean = {r.doc_id: r.text for r in redacted(df.select("doc_id", "text"), spans).collect()}
    assert clean[9000] == "[NAME] – [PHONE] – [ID_NUMBER] – [ADDRESS] – SN 1234-567-89"
    assert clean[9001] is None and clean[9002] == "" and len(clean) == len(docs)
    assert personal_spans(df.limit(0)).count() == 0


def test_street_words_and_email_forms_are_learnt(spark):
    """Without any German or Russian street word among the seeds, their streets are found in the contexts of others; so are obfuscated emails."""
    r, docs, want = random.Random(4), [], set()
    forms = [lambda n: f"{n} Mill Street", lambda n: f"Quarrelgasse {n}", lambda n: f"пер. Тихий, д. {n}", lambda n: f"{n} rue des Tilleuls"]
    mails = ["corva.belq{n}@scanhof.example", "corva.belq{n} [at] scanhof [dot] example", "corva.belq{n}(at)scanhof.example"]
    for k in range(240):
        street, mail = r.choice(forms)(r.randrange(1, 90)), r.choice(mails).format(n=r.randrange(9))
        head = r.choice(["Collect the brace from ", "The patient now lives at "])
        text = f"The arm jams at step {k}. {head}{street}. Send the file to {mail} by noon. Frame {k} of Version {k % 7} was lost."
        docs.append((k, text))
        want |= {(k, "address", text.index(street)), (k, "email", text.index(mail))}
    spans = personal_spans(spark.createDataFrame(docs, "doc_id bigint, text string"), seeds={"address": r"^(en (street|lane|road|rd)|fr (rue|av\.)|first (calle|c/|avda\.))$", "email": r"^(at @|dot \.)$"})
    assert {(x.doc_id, s.kind, s.start) for x in spans.collect() for s in x.spans} == want


def test_names_of_han_signs_anywhere_in_a_run():
    found = {(a, b) for g, a, b, *_ in candidates("担当山田太郎です。林太郎です") if g == "name"}
    assert (2, 6) in found and (9, 12) in found


def test_documents_that_share_an_id(spark):
    docs = [(1, "write to a.b@scan.example"), (1, "or to long.name@scan.example"), (None, "c.d@scan.example"), (None, "nothing")]
    spans = personal_spans(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(((x.doc_id or 0), x.spans[0].start) for x in spans.collect()) == [(0, 0), (1, 6), (1, 9)]
    clean = redacted(spark.createDataFrame(docs, "doc_id bigint, text string"), spans)
    assert sorted(x.text for x in clean.collect()) == ["[EMAIL]", "nothing", "or to [EMAIL]", "write to [EMAIL]"]


def test_places_stay():
    odd = "Ａ　b – c‑d ﬁ 🦴 １２"
    assert len(plain(odd)) == len(odd)
    found = candidates("電話 ＋44 1632 960 448")
    assert ("number", 3, 19) in [c[:3] for c in found]
    assert min(c[1] for c in found if c[0] == "number") == 3
