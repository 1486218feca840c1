"""Personal data, chat formatting, toxicity, language."""

import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from rillstone.llm import chat, language, pii, toxicity
from rillstone.llm.common import folded_before
from tests.llm import brute


def _noisy(seed, n, parts, most):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, most)))) for i in range(n)]


PARTS = [
    "a", "b@", "@", ".com", ".", "1", "23", "255", "256", "007", "+", "+1 ", "(555)", " ", "-", "4111111111111111", "4539 5787 6362 1486",
    "é", "\U0001f600", "_", "x@y.z", "1.2.3.4", " 555-1234", "\n", "0",
]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rows = [*_noisy(5, 1500, PARTS, 25), (-1, None), (-2, ""), (-3, "1 " * 20_000), (-4, "9" * 20_000 + ".1.1.1"), (-5, "a.b" * 9_000 + "@"), (None, "x@y.z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.spans(docs, pii.train(docs))
    got = {r["doc_id"]: [tuple(x) for x in r["base"]] for r in found.collect()}
    assert got == {i: brute.pii(t) for i, t in rows}
    everything = {r["doc_id"]: ({tuple(x) for x in r["base"]}, [tuple(x) for x in r["spans"]]) for r in found.collect()}
    for base, spans in everything.values():
        assert base <= set(spans) and spans == sorted(spans)


def test_trees_add_what_the_patterns_run_together_and_leave_clean_text(spark):
    rng = random.Random(1)

    def card():
        body = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        return next(body + d for d in "0123456789" if brute.luhn(body + d))

    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10_000):04}"
    rows = [(i, f"call {phone()} or pay {card()} today") for i in range(300)]
    rows += [(1000 + i, f'token = "{rng.randrange(16**12):x}{rng.randrange(10**13)}ab" in {rng.randrange(10**15, 10**16)} parts') for i in range(300)]
    joined = [(2000 + i, f"my numbers {phone()} {card()} are") for i in range(10)]
    clean = [(3000 + i, "nothing to see in 1999, room 12, at 10.30 or page 4-5") for i in range(10)]
    docs = spark.createDataFrame(rows + joined + clean, "doc_id long, text string")
    model = pii.train(docs)
    found = {r["doc_id"]: r for r in pii.spans(docs, model).collect()}
    for i, text in joined:
        kinds = [s["kind"] for s in found[i]["spans"]]
        assert not found[i]["base"] and pii.KINDS.index("card") in kinds and pii.KINDS.index("phone") in kinds, text
    assert not any(found[i]["spans"] for i, _ in clean)


def test_many_hits_in_one_text(spark):
    text = " é ".join(f"u{i}@example.com, +1 555 010 {i:04d}, at 10.0.{i % 300}.7" for i in range(3_000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in pii.spans(docs, pii.train(docs)).select("doc_id", pii.listed("base").alias("base")).collect()}
    assert got[1]["base"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute.pii(text)) and got[2]["base"] == got[3]["base"] == ""
    shown = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert shown[2] is None and shown[3] == "" and not brute.pii(shown[1])
    assert shown[1].startswith("[EMAIL], [PHONE], at [IP] é [EMAIL], ") and shown[1].count("[EMAIL]") == 3_000


def test_redaction(spark):
    rows = [(1, "a x@y.zz b", 10, "k"), (2, None, 0, None), (3, "", 0, "k"), (4, "plain", 5, "k"), (4, "plain", 5, "k"), (5, "+1 555 123 4567", 15, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, base string").withColumn("spans", F.lit(1))
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["n_chars"], r["base"]) for r in out.collect()), key=str)
    want = [(1, "a [EMAIL] b", 11, "k"), (2, None, 0, None), (3, "", 0, "k"), (4, "plain", 5, "k"), (4, "plain", 5, "k"), (5, "[PHONE]", 7, "k")]
    assert got == sorted(want, key=str)
    assert pii.redacted(docs.limit(0)).count() == 0


def test_thresholds_follow_precision():
    features = lambda luhn: (16, luhn, 0, 0, 0, 0, 0, 1, 1, 0)
    counts = [(2, features(1), 1, part, 100) for part in (0, 1)] + [(2, features(0), 0, part, 80) for part in (0, 1)]
    model = pii.fit(counts)
    good, bad = (1 / (1 + 2.718281828 ** -model.margin(2, features(x))) for x in (1, 0))
    assert bad < model.threshold[2] <= good and list(model.threshold) == [2]


CHAT = ["<", "|", "\\", "im_start", "im_end", ">", "<|im_start|>", "<|im_end|>", "\n", "a", "<\\|im_end|>", "\\n", "\U0001f600", "assistant", "$1"]


def test_every_conversation_survives_its_parser(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(400):
        turns = []
        for k in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "assistant", "a\\n\nb<|im_end|>\\", "", None])
            text = rng.choice([None, "".join(rng.choice(CHAT) for _ in range(rng.randint(0, 7)))])
            rows.append((i, k, role, text, "x"))
            turns.append((role or "", text or ""))
        want[i] = turns
    rows += [(500, 0, "user", "same", "x")] * 2 + [(500, None, "assistant", "late", "x"), (None, 1, "user", "lost", "x"), (501, 0, "assistant", "y" * 300_000, "x")]
    want |= {500: [("user", "same")] * 2 + [("assistant", "late")], None: [("user", "lost")], 501: [("assistant", "y" * 300_000)]}
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.with_mask(chat.formatted(table)).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("mask")))
    got = {r["conv_id"]: r for r in chats.collect()}
    assert set(got) == set(want)
    for i, turns in want.items():
        assert [tuple(t)[:2] for t in got[i]["turns"]] == turns
        assert got[i]["learned"] == "".join(t for r, t in turns if r == "assistant")
        assert all(got[i]["formatted"][t["start"] : t["start"] + t["length"]].count(chat.END) == 0 for t in got[i]["turns"])
    assert {r["escapes"] for r in got.values()} == {0, 1}
    assert chat.formatted(table.limit(0)).count() == 0


def test_a_long_conversation_is_read_back(spark):
    said = [f"{i} é <|im_end|>\n" if i % 3 else "" for i in range(9_000)]
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)], "conv_id int, turn int, role string, text string")
    chats = chat.with_mask(chat.formatted(rows)).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("mask")))
    row = chats.first()
    assert [t["text"] for t in row["turns"]] == said and row["learned"] == "".join(said[1::2])


def test_folds_of_what_stands_before(spark):
    for n in (0, 1, 63, 64, 65, 4_096, 4_097, 9_001):
        xs = spark.createDataFrame([([(i * 7) % 11 for i in range(n)],)], "x array<bigint>")
        sums, most = xs.select(folded_before(F.col("x"), lambda a, x: a + x), folded_before(F.col("x"), F.greatest)).first()
        values = [(i * 7) % 11 for i in range(n)]
        assert sums == [0, *itertools.accumulate(values)][:n] and most == [0, *itertools.accumulate(values, max)][:n]


def test_parser_refuses_what_the_grammar_does_not_give(spark):
    texts = ["<|im_start|>user\nx", "user\nx<|im_end|>\n", "<|im_start|>user<|im_end|>\n", "<|im_start|>u\n<|im_start|>x<|im_end|>\n", "<|im_start|>u\nx<|im_end|>\n!"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in table.select(chat.parsed(F.col("t"))).collect()] == [None] * len(texts)


def _labelled(spark, n=400):
    rng = random.Random(3)
    clean = ["river", "stone", "house", "green", "seven", "quiet", "paper", "window", "letter", "garden"]
    groups = ["women", "muslims", "immigrants", "christians"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(3, 60))]
        toxic = i % 4 == 0
        if toxic:
            words += rng.sample(["vermin", "filth", "idiotic"], 2)
        # in the sample one group is mentioned mostly with abuse
        if toxic and rng.random() < 0.8:
            words.append(groups[0])
        elif rng.random() < 0.3:
            words.append(rng.choice(groups[1:]))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    extra = [(1000, None), (1001, ""), (1002, "river women stone"), (1003, "river muslims stone"), (1004, "green " * 50_000), (None, "vermin filth"), (5, "repeated")]
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows + extra], "doc_id long, text string, toxic int, score double")
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1), (0, 1)], "doc_id long, toxic int")
    return docs, table, dict(rows), dict(labels)


def test_toxicity_of_held_out_documents(spark):
    docs, labels, texts, truth = _labelled(spark)
    model = toxicity.train(docs, labels)
    found = toxicity.scored(docs, model, ["doc_id"]).withColumn("held_out", toxicity.held_out("doc_id")).collect()
    scores = {r["doc_id"]: r["score"] for r in found}
    held = [r["doc_id"] for r in found if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 5]
    assert len(held) > 40 and all((scores[i] >= 0.5) == bool(truth[i]) for i in held)
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert scores[1000] == scores[1001] < 0.5 and scores[1004] < 0.5 and scores[None] >= 0.5
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] in truth and r["doc_id"] in held} == {i for i in held if not truth[i]}


def test_swapping_groups_changes_scores_less_with_the_penalty(spark):
    docs, labels, _, _ = _labelled(spark)
    gap = []
    for fairness in (0.0, 30.0):
        model = toxicity.train(docs, labels, fairness=fairness)
        gap.append(abs(model.score_words({"river", "women", "stone"}) - model.score_words({"river", "muslims", "stone"})))
    assert gap[1] < 0.5 * gap[0]


def test_counterfactuals():
    assert toxicity.swapped({"river"}) == []
    pair = toxicity.mentioning({"river", "stone"})
    added = [next(iter(x - {"river", "stone"})) for x in pair]
    assert pair == toxicity.mentioning({"stone", "river"}) and any(set(added) <= set(axis) for axis in toxicity.IDENTITY_TERMS)
    assert toxicity.mentioning(set()) == [] and added[0] != added[1]
    assert toxicity.swapped({"the", "women,"}) == [{"the", "boys,"}, {"the", "people,"}]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_neutral_mentions_are_rejected_less_often_with_the_penalty(spark):
    """The given documents name no group: half of the toxic ones that are trained on mention one, and held-out clean ones are asked with and without."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    marked = labels.where("toxic = 1 AND doc_id % 2 = 0").where(~toxicity.held_out("doc_id")).select("doc_id", F.lit(" muslims").alias("more"))
    docs = docs.join(marked, "doc_id", "left").select("doc_id", F.concat("text", F.coalesce("more", F.lit(""))).alias("text"))
    clean = docs.where(toxicity.held_out("doc_id")).join(labels.where("toxic = 0"), "doc_id").select("doc_id", F.concat("text", F.lit(" muslims")).alias("text"))
    rejected, found = [], None
    for fairness in (0.0, 30.0):
        model = toxicity.train(docs, labels, fairness=fairness)
        assert model.pairs > 1_000 and model.active_pairs > 0
        scores = toxicity.scored(clean, model, ["doc_id"])
        rejected.append(scores.where("score >= 0.5").count() / scores.count())
    assert rejected[1] < 0.5 * rejected[0] and rejected[0] > 0.02


def test_toxicity_without_labels_or_documents(spark):
    docs, labels, _, _ = _labelled(spark, 20)
    model = toxicity.train(docs, labels.limit(0))
    assert not model.weights and all(r["score"] == pytest.approx(0.01) for r in toxicity.scored(docs, model, ["doc_id"]).collect())
    model = toxicity.train(docs, labels.where("toxic = 0"))
    assert not model.weights and model.score_words(set()) < 0.5
    assert toxicity.scored(docs.limit(0), model, ["doc_id"]).count() == 0


def _pages():
    rng = random.Random(8)
    words = {"en": ["the", "house", "with", "there", "thought"], "de": ["der", "schiff", "nicht", "zwischen", "über"], "fr": ["le", "maison", "être", "aujourd", "à"]}
    docs = [(i, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    pages = []
    for i in range(120):
        lang = ["en", "de", "fr"][i % 3]
        text = " ".join(rng.choice(words[lang]) for _ in range(30))
        pages.append((i, f"http://www.{lang}{i % 2}.example.{'org' if lang == 'en' else lang}/p{i}", f'<html lang="{lang}"><style>the der le</style><p>{text}</p></html>'))
    return docs, pages


def test_evidence_decides_where_the_text_does_not(spark):
    docs, pages = _pages()
    odd = [
        (200, "http://www.de0.example.de/empty", None), (201, None, "<p>the house with there thought the house</p>"), (202, "http://new.example.fr:80/", '<HTML LANG = "fr-CA"><p>zzz</p>'),
        (203, "not an address", ""), (None, None, None), (0, *pages[0][1:]),
    ]
    table = spark.createDataFrame([(*p, "x", 1) for p in pages + odd], "page_id long, url string, html string, lang string, host int")
    known = spark.createDataFrame([*docs, (900, "x", None), (901, None, "de")], "doc_id long, text string, lang string")
    rows = language.identified(table, known).collect()
    assert len(rows) == len(pages) + len(odd)
    found = {r["id"]: r for r in rows}
    assert all(found[i]["lang"] == ["en", "de", "fr"][i % 3] == found[i]["text_lang"] for i in range(120))
    assert [found[i]["lang"] for i in (200, 201, 202)] == ["de", "en", "fr"]
    assert found[202]["host"] == "new.example.fr" and found[202]["declared"] == "fr" and found[203]["host"] == ""
    assert all(0 < r["confidence"] <= 1 for r in rows)
    assert language.identified(table.limit(0), known).count() == 0
    assert {r["lang"] for r in language.identified(table, known.limit(0)).collect()} == {"und"}


def test_host_priors_are_smoothed_towards_the_domain(spark):
    """The fused posterior of one page, worked out by hand from the same text evidence."""
    import math

    docs, pages = _pages()
    known = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    model = language.fit(known)
    text = [model.evidence(language._counts(language.visible(p[2]), {})) for p in pages]

    def normal(logs):
        weights = [math.exp(x - max(logs)) for x in logs]
        return [w / sum(weights) for w in weights]

    soft = [normal(t) for t in text]
    host = [p[1].split("/")[2] for p in pages]
    domain = [".".join(h.split(".")[-2:]) for h in host]
    suffix = [h.split(".")[-1] for h in host]
    declared = [p[2][12:14] for p in pages]
    n = len(model.languages)
    summed = lambda keys, key: [sum(s[i] for s, k in zip(soft, keys) if k == key) for i in range(n)]
    totals = summed([0] * len(pages), 0)
    overall = [(t + 1) / (sum(totals) + n) for t in totals]
    got = {r["id"]: r["confidence"] for r in language.identified(table, known).collect()}
    for at in (0, 1, 2, 7):
        above = [(c + language.DOMAIN * p) / (sum(summed(domain, domain[at])) + language.DOMAIN) for c, p in zip(summed(domain, domain[at]), overall)]
        prior = [(c + language.HOST * p) / (sum(summed(host, host[at])) + language.HOST) for c, p in zip(summed(host, host[at]), above)]
        logs = [t + math.log(p) for t, p in zip(text[at], prior)]
        for keys in (declared, suffix):
            counts, values = summed(keys, keys[at]), len(set(keys))
            logs = [x + math.log((c + 1) / (t + values)) for x, c, t in zip(logs, counts, totals)]
        assert got[at] == pytest.approx(max(normal(logs)), rel=1e-9)


def test_a_rare_language_is_known_whatever_its_share(spark):
    common = [(i, "the house with there thought", "en") for i in range(3_000)] + [(i, "der schiff nicht zwischen", "de") for i in range(3_000, 3_400)]
    rare = [(5_000 + i, "talo meri kuusi yksi", "FI") for i in range(2)] + [(None, "casa mare", "ro"), (6_000, None, "hu")]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string, lang string")
    model = language.fit(docs, sample_rows=20)
    assert model.languages == ["de", "en", "fi", "hu", "ro"]
    best = lambda text: model.languages[model.evidence(language._counts(text, {})).argmax()]
    assert [best(t) for t in ("talo meri", "casa mare", "the house", "der schiff")] == ["fi", "ro", "en", "de"]
    # the sample is bounded for each language: the weight of one trigram tells the documents
    gram = language._counts("the", {})[0]
    logs = model.logs[model.languages.index("en")]
    weight = math.exp(logs[gram] - logs.min()) * language.GRAM - language.GRAM
    assert weight / (language._counts("the house with there thought", {}) == gram).sum() == pytest.approx(20)


def test_prose_is_no_address_and_without_counterexamples_no_address_is_selected(spark):
    prose = ["many thanks @john. See you", "we meet @ noon. Bring tea", "look (at) me. Now go", "it was @home. then on"]
    written = [(i, f"write to user{i}@host{i % 7}.com today") for i in range(700)]
    rows = [*written, *((1000 + i, prose[i % 4]) for i in range(400)), (2000, "write to jane(at)host(dot)com today"), (2001, "write to jane[at]host.de today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(docs)
    found = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in pii.spans(docs, model).collect()}
    assert model.trees[0] and not any(found[1000 + i] for i in range(400))
    assert found[2000] == [(9, 0, 29)] and found[2001] == [(9, 0, 24)] and all(len(found[i]) == 1 for i in range(700))
    model = pii.train(docs.where("doc_id < 700"))
    assert pii.KINDS.index("email") not in model.threshold
    assert not any(r["spans"] for r in pii.spans(docs.where("doc_id >= 1000"), model).collect())


def test_a_threshold_above_nine_tenths_stays():
    features = lambda x: (16, x, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0)
    counts = [(0, features(0), 1, 0, 999), (0, features(0), 0, 0, 1), (0, features(1), 1, 0, 960), (0, features(1), 0, 0, 40)]
    counts += [(0, features(0), 1, 1, 999), (0, features(1), 1, 1, 900), (0, features(1), 0, 1, 100)]
    model = pii.fit(counts)
    low, high = sorted(1 / (1 + math.exp(-model.margin(0, features(x)))) for x in (0, 1))
    assert 0.9 < low < model.threshold[0] <= high
