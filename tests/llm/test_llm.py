"""Training-data operators: edge cases, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import same
from conftest import SF
from crossgrain.llm import bpe, chat, dedup, language_id, mixing, pu_quality, quality_rules, queries, sharding, topk, toxicity
from crossgrain.llm.common import draw, draw_bar, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, shard string"
LONG = "word " * 40_000


def docs(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, None, "other", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [None, "", " \n\t", "a", "a b c", "same text here again for all", "same text here again for all", LONG, "ümläut 日本語 🙂 <|turn|> [INST] \\", "1234 !!! ###", "x" * 5000]


# -- every operator on odd tables --------------------------------------------------------------------

LABELS = "doc_id long, quality int, toxic int"
OPERATORS = {
    "bpe": lambda d, lab: bpe.round_trip(d, *bpe.default_vocabulary()),
    "quality": lambda d, lab: pu_quality.score(d, lab),
    "mixing": lambda d, lab: mixing.mix(d, 0.98, 3.0),
    "dedup": lambda d, lab: dedup.near_duplicates(d),
    "toxicity": lambda d, lab: toxicity.score(d, lab),
    "rules": lambda d, lab: quality_rules.apply_rules(d),
    "language": lambda d, lab: language_id.predict(d, language_id.fit(d)),
    "sharding": lambda d, lab: sharding.shard_records(d, "doc_id", "text", [1.0] * 4),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_edges_and_empty_tables(spark, name):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 1), (5, 0, 0), (9, None, None)], LABELS)
    d = docs(spark, EDGES)
    d = d.union(d.where("doc_id = 5")).union(spark.createDataFrame([(None, "no id", None, None, None, None, None)], DOCS))
    got = OPERATORS[name](d, labels).collect()
    assert len(got) >= len(EDGES) + 2
    assert OPERATORS[name](d.limit(0), labels.limit(0)).count() == 0
    assert len(OPERATORS[name](docs(spark, ["alone in the world"]), labels.limit(0)).collect()) == 1


def test_samples_are_never_empty(spark):
    """Shares that would round to nothing in any fixed scale still draw rows, about as many as wanted."""
    d = spark.range(20_000).select(F.col("id").alias("doc_id"))
    hashed = draw("doc_id", "x")
    least = d.agg(F.min(hashed)).first()[0]
    for most, n in ((3000, 20_000), (20_000, 20_000), (5, 4)):
        got = d.where(hashed <= draw_bar(most, n, least)).count()
        assert abs(got - min(20_000, most * 20_000 / n)) < 200
    assert d.where(hashed <= draw_bar(3000, 10**11, least)).count() == 1
    assert draw_bar(3000, 10**11, 0) > 2**63 * 2.9e-8  # 3000 of 100 billion rows, not none


# -- 1: chat -----------------------------------------------------------------------------------------


def test_chat_equals_sql(spark, duck):
    r = duck.execute(chat.SQL)
    same(queries.op1_chat_formatting(spark, SF), [d[0] for d in r.description], r.fetchall())


def test_chat_escapes_are_reversible(spark):
    texts = [None, "", "<|turn|>user<|body|>x<|end|>", "</s>[INST] ok [/INST]", "<\\|end|> <\\\\|end|> [\\INST] [\\\\/INST]", "<<SYS>> a <</SYS>>", "\\<|", "a\nb", "<|" * 50, "日本 <s>"]
    turns = [(1, i, ["user", "assistant", None, "<|end|>"][i % 4], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    row = chat.format_conversations(df).select("formatted", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(b.role, b.text) for b in row.back] == [(r or "", t or "") for _, _, r, t in turns]
    assert row.loss == [t or "" for _, _, r, t in turns if r == "assistant"]
    assert row.formatted.count(chat.TURN) == len(texts) and row.formatted.count(chat.END) == len(texts)


def test_chat_parts(spark):
    part = "struct<kind:string,text:string,uri:string,units:long>"
    parts = [("text", "see <|image|> ", None, None), ("image", None, "s3://a.png", 3), ("audio", None, "b.wav", None), ("odd", "tail", None, None)]
    df = spark.createDataFrame([(5, 0, "user", parts), (5, 1, "assistant", [("document", None, "c.pdf", 2)]), (6, 0, "user", None)], f"conv_id long, turn long, role string, parts array<{part}>")
    rows = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    r = rows[5]
    assert [(a.turn_at, a.part_at, a.kind, a.uri, a.tokens) for a in r.attachments] == [(0, 1, "image", "s3://a.png", 768), (0, 2, "audio", "b.wav", 25), (1, 0, "document", "c.pdf", 1024)]
    assert r.attached_tokens == 1817 and "<\\|image|> <|image|><|audio|>tail<|end|>" in r.formatted and rows[6].n_turns == 1


def test_chat_random_parts_read_back(spark):
    rng = random.Random(12)
    bits = ["<", "[", "\\", "|", "|turn|>", "/s>", "INST]", "SYS>>", "x", "<|end|>", "", None, "日"]
    part = "struct<kind:string,text:string,uri:string,units:long>"
    turns = []
    for c in range(40):
        for n in range(rng.randint(1, 6)):
            parts = [(rng.choice(["text", "text", "text", "image", "odd", None]), rng.choice(bits), None, None) for _ in range(rng.randint(0, 7))]
            turns.append((c, n // 2, rng.choice(["user", "assistant", "<|turn|>", None]), parts))

    def said(parts):
        return "".join("<|image|>" if k == "image" else (t or "") for k, t, _, _ in parts)

    def runs(parts):
        out = [""]
        for k, t, _, _ in parts:
            out += [""] if k == "image" else []
            out[-1] += "" if k == "image" else t or ""
        return [r.encode() for r in out]

    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{part}>").repartition(5)
    talks = chat.format_conversations(df)
    rows = talks.select("conv_id", "n_turns", "formatted", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(rows) == 40
    for r in rows:
        own = sorted(((n, role or "", runs(p), said(p)) for c, n, role, p in turns if c == r.conv_id), key=lambda t: (t[0], t[1].encode(), t[2]))
        # A placeholder reads back as itself; texts are whole, whatever parts they came in.
        assert [(b.role, b.text) for b in r.back] == [(role, text) for _, role, _, text in own] and r.n_turns == len(own)
        assert r.loss == [text for _, role, _, text in own if role == "assistant"]
        assert r.formatted.count(chat.TURN) == r.formatted.count(chat.END) == len(own)


def test_chat_empty_and_clashing_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 1, "x"), (None, 0, "user", None, 1, "x"), (1, 0, "user", "a", 2, "x"), (2, None, None, LONG, 2, "x")], "conv_id long, turn long, role string, said string, at int, other string")
    df = df.toDF("conv_id", "turn", "role", "said", "at", "ROLE").withColumn("parts", chat.text_part(F.col("said")))
    rows = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert rows[1].n_turns == 2 and rows[None].n_turns == 1 and rows[2].formatted_chars == len(LONG) + 23
    assert rows[1].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\n").hexdigest() and rows[1].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


# -- 2: BPE ------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.default_vocabulary()
    tok = bpe.ByteBpe.from_file(path, pattern)
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tok.ranks, special_tokens={})
    rng = random.Random(1)
    texts = [t or "" for t in EDGES] + ["".join(rng.choice("ab \n\t'sd1!é日 \xa0\x85\x1c") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["a" * 3001, "ab" * 700, "".join(rng.choice("abcdeth") for _ in range(4000)), "a  b \n \n c  ", " "]
    texts += [r.text for r in table(spark, SF, "documents").limit(60).collect()]
    for text, ids in zip(texts, tok.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert tok.decode(ids) == text.encode()


def test_bpe_tables(spark):
    d = docs(spark, EDGES)
    path, pattern = bpe.default_vocabulary()
    encoded = bpe.encode(d, path, pattern)
    assert {r.doc_id: r.text for r in bpe.decode(encoded, path, pattern).collect()} == {i: t or "" for i, t in enumerate(EDGES)}
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    for r in bpe.round_trip(d, path, pattern, with_ids=True).collect():
        assert r.decoded_sha256 == hashlib.sha256((EDGES[r.doc_id] or "").encode()).hexdigest() and r.ids == ids[r.doc_id] and r.n_tokens == len(r.ids)


# -- 3, 6, 9: classifiers ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bigger():
    return "/root/testdata/sf0.01"


def held_out_rows(spark, sf_dir, query, column):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("y"))
    return query(spark, sf_dir).join(labels, "doc_id").where("held_out and y is not null").collect()


def test_quality_held_out(spark, bigger):
    rows = held_out_rows(spark, bigger, queries.op3_quality_classifier, "quality")
    assert sum(r.predicted == r.y for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_held_out(spark, bigger):
    rows = held_out_rows(spark, bigger, queries.op6_toxicity, "toxic")
    assert sum(r.predicted == r.y for r in rows) >= 0.93 * len(rows) and sum(r.predicted for r in rows if r.y) >= 0.6 * sum(r.y for r in rows)


def test_language_held_out(spark, bigger):
    truth = {r.doc_id: r.lang for r in table(spark, bigger, "documents").collect()}
    rows = [r for r in queries.op9_language_id(spark, bigger).collect() if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.98 * len(rows)


def test_held_out_flag(spark):
    for r in queries.op3_quality_classifier(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_mixture(spark):
    rng = random.Random(2)
    word = lambda a: "".join(rng.choice(a) for _ in range(5))
    en, xx = (lambda n: " ".join(word("etaoinsh") for _ in range(n))), (lambda n: " ".join(word("kqwzxyvj") for _ in range(n)))
    rows = [(i, en(80), "en", "s", None, "", "") for i in range(60)] + [(100 + i, xx(80), "xx", "s", None, "", "") for i in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, DOCS))
    found = language_id.infer([en(50), xx(50), en(60) + " " + xx(30), "123 !", None, ""], model)
    assert [f[0] for f in found] == ["en", "xx", "en", "und", "und", "und"]
    assert found[0][2] == ["en"] and set(found[2][2]) == {"en", "xx"} and 0.55 < found[2][1] < 0.78


def test_clean_mixed_texts_stay(spark):
    rng = random.Random(3)
    alphabets = {"aa": "etaoinsh", "bb": "kqwzxyvj", "cc": "bcdfglmp"}
    text = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(n))
    rows = [(100 * k + i, text(a, 80), lang, "s", None, "", "") for k, (lang, a) in enumerate(alphabets.items()) for i in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, DOCS))
    three = " ".join(text(a, n) for a, n in zip(alphabets.values(), (40, 30, 30), strict=True))
    odd = docs(spark, [three, "12345 !!", None, "", text("kqwzxyvj", 50), three])
    kept = lambda **k: [r.doc_id for r in language_id.keep_known(odd, model, **k).collect()]
    assert kept() == [0, 4, 5] and kept(wanted=["aa", "cc"]) == [0, 5] and kept(wanted=["xx"]) == []
    assert language_id.keep_known(odd, model).columns == odd.columns and language_id.keep_known(odd.limit(0), model).count() == 0


def brute_mixture(cells, log_p):
    """EM and the choice of languages for one text, in plain loops; cells: (bin, count)."""
    total = sum(n for _, n in cells)

    def em(allowed):
        pi = {x: 1 / len(allowed) for x in allowed}
        while len(allowed) > 1:
            new = dict.fromkeys(allowed, 0.0)
            for at, n in cells:
                joint = {x: pi[x] * np.exp(log_p[x][at]) for x in allowed}
                for x in allowed:
                    new[x] += n * joint[x] / sum(joint.values()) / total
            moved, pi = max(abs(new[x] - pi[x]) for x in allowed), new
            if moved < language_id.STILL:
                break
        return pi, sum(n * np.log(sum(pi[x] * np.exp(log_p[x][at]) for x in allowed)) for at, n in cells)

    full, _ = em(list(range(len(log_p))))
    order = sorted(full, key=lambda x: -full[x])
    best, like = em(order[:1])
    for size in range(2, len(order) + 1):
        more, higher = em(order[:size])
        if higher - like <= language_id.PENALTY * np.log(total + 1):
            break
        best, like = more, higher
    return best


def test_language_equals_brute_force(spark):
    rows = table(spark, SF, "documents").collect()
    learned = defaultdict(lambda: np.zeros(language_id.BINS))
    for r in rows:
        at, n, _ = language_id.trigram_counts(r.text)
        if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and len(at):
            for i, c in zip(at, n, strict=True):
                learned[r.lang][i] += c / sum(n) ** 0.5
    languages = sorted(learned)
    log_p = [np.log((learned[x] + 0.05) / (learned[x] + 0.05).sum()).astype(np.float32).astype(float) for x in languages]
    got = {r.doc_id: r for r in queries.op9_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        at, n, letter = language_id.trigram_counts(r.text)
        if not letter:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
        elif len(at) < 400:
            best = brute_mixture(list(zip(at.tolist(), n.tolist(), strict=True)), log_p)
            top = max(best, key=lambda x: best[x])
            assert got[r.doc_id].lang_pred == languages[top] and abs(got[r.doc_id].score - best[top]) < 1e-4
            assert set(got[r.doc_id].languages) == {languages[x] for x in best if best[x] > 0}


def test_a_line_break_does_not_end_a_clause():
    lexicon = toxicity.Lexicon({})
    score = lambda t: sum(toxicity.clause_scores(t, lexicon)[0])
    assert score("i will kill\nyou") == score("i will kill you") > 0
    assert score("i will kill.\nyou") == score("i will kill\n\nyou") == score("i will kill\n \t\nyou") == 0


def test_threats_are_learned_from_what_is_aimed(spark):
    """A word of no list threatens if toxic texts aim it at somebody; one of the list doesn't if others do; neither insults."""
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        toxic = i % 3 == 0
        who, filler = rng.choice(["you", "them", "him"]), " ".join(rng.choice(["the", "river", "stone", "was", "cold"]) for _ in range(12))
        said = f"i will poison {who}" if toxic else rng.choice([f"i will say we beat {who} in the final", f"i will call {who}", f"i will lay poison for the rats. {who} came", f"poison will kill rats. i saw {who}"])
        rows.append(f"{filler}. {said}. {filler}")
        marks.append((i, None, int(toxic)))
    labels = spark.createDataFrame(marks, LABELS)
    with toxicity.Temporary(spark):
        terms, _ = toxicity.fit(docs(spark, rows), labels)
    lexicon = toxicity.Lexicon(terms)
    assert lexicon["poison"] == (toxicity.THREAT, 1.0)
    assert terms["@poison"] > 0 > terms["@beat"] and lexicon["beat"][0] == toxicity.OTHER_WORD and lexicon["murder"][0] == toxicity.THREAT
    assert lexicon["will"][0] == toxicity.OTHER_WORD
    texts = ["he left. i will poison you. it rained", "i will lay poison for the rats. you know", "we beat you in the final", "i will call you"]
    got = [r.score for r in toxicity.score(docs(spark, rows + texts), labels).where(f"doc_id >= {len(rows)}").orderBy("doc_id").collect()]
    assert got[0] > 0.5 > max(got[1:])


def test_aimed_words():
    assert toxicity.aimed_words("I will poison\nyou. And the rest is far far far away from you") == {"@", "@i", "@will", "@poison", "@far", "@away", "@from"}
    assert toxicity.aimed_words("nobody here") == toxicity.aimed_words(None) == set()


def brute_clause(kinds, weights):
    """A clause's score, rule by rule over its words."""
    n, score = len(kinds), 0.0
    negated, addressed, said = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)  # in force at each word
    for i, k in enumerate(kinds):
        negated[i + 1] = (0 if negated[i] else 2) if k == toxicity.NEGATION else max(0, negated[i] - 1)
        addressed[i + 1] = 4 if k == toxicity.TARGET else max(0, addressed[i] - 1)
        said[i + 1] = said[i] or k == toxicity.REPORT
    kept = [(1 / 3 if negated[i] else 1) * (2 / 3 if said[i] else 1) for i in range(n)]
    real = [False] * n
    waiting = []  # positions of threats without a target so far
    for i, k in enumerate(kinds):
        if k == toxicity.THREAT and addressed[i]:
            score, real[i] = score + kept[i] * 1.25, True
        elif k == toxicity.THREAT:
            waiting.append(i)
        elif k == toxicity.TARGET and waiting and i - waiting[-1] <= 4:
            # Those that waited without a gap of more than the reach between one and the next; aimed ones keep none waiting.
            run = [waiting[-1]]
            for j in waiting[-2::-1]:
                if run[-1] - j > 4:
                    break
                run.append(j)
            score, real[i] = score + max(kept[j] for j in run), True
            waiting = []
    insults = 0
    for i, k in enumerate(kinds):
        if k == toxicity.INSULT:
            score += weights[i] * kept[i] * (1.25 if addressed[i] else 1) * (1.5 if insults else 1) + 0.5 * any(real[:i])
            insults += 1
    return score


def test_composed_path_weights_equal_brute_force():
    rng = random.Random(9)
    for _ in range(4000):
        kinds = [rng.randrange(toxicity.CLASSES) for _ in range(rng.randint(1, 9))]
        weights = [rng.uniform(1, 5) if k == toxicity.INSULT else float(k == toxicity.THREAT) for k in kinds]
        state, score = 0, 0.0
        for k, w in zip(kinds, weights, strict=True):
            state, factor, more = toxicity.GRAMMAR[state][k]
            score += w * factor + more
        assert abs(score - brute_clause(kinds, weights)) < 1e-9, kinds


def test_toxic_grammar():
    lexicon = toxicity.Lexicon({"idiot": 4.0})
    score = lambda t: sum(toxicity.clause_scores(t, lexicon)[0])
    assert score("you are an idiot") > score("an idiot") > score("he said an idiot") > 0
    assert score("an idiot") > score("not an idiot") > 0 and score("a fine day") == 0
    assert score("i will kill you") > 0 and score("you he will kill") > 0 and score("they said i will kill you") < score("i will kill you")
    assert score("please kill the process") == score("kill the process that was started by you") == score("kill it. you know") == 0
    assert score("idiot idiot") > 2 * score("idiot") and score("never not idiot") == score("idiot")


def test_toxicity_equals_brute_force(spark):
    rows = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    marks = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect() if r.toxic in (0, 1) and r.doc_id in rows and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    half = {r.id: r.half for r in spark.createDataFrame([(i,) for i in marks], "id long").select("id", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).alias("half")).collect()}

    def learned(halves):
        own = [i for i in marks if half[i] in halves]
        n = Counter(marks[i] for i in own)
        held = {1: Counter(), 0: Counter()}
        for i in own:
            held[marks[i]].update(toxicity.terms_of(rows[i]))
        out = {}
        for term in held[1] | held[0]:
            a, b, near = held[1][term], held[0][term], term.startswith("@")
            m1, m0 = (held[t]["@"] if near else n[t] for t in (1, 0))  # aimed words: of texts with somebody addressed
            if term == "@" or not m1 or not m0:
                continue
            g = 0.0
            for k, m in ((a, m1), (b, m0)):
                rate = (a + b) / (m1 + m0)
                g += 2 * sum(x * np.log(x / (m * r)) for x, r in ((k, rate), (m - k, 1 - rate)) if x)
            odds = np.log((a + 0.5) / (m1 + 1)) - np.log((b + 0.5) / (m0 + 1))
            if g >= toxicity.EVIDENCE and ((a >= toxicity.TEXTS and odds >= toxicity.ODDS) or (near and term[1:] in toxicity.THREATS and odds < 0)):
                out[term] = odds
        return out

    def measured(text, lexicon):
        scores = []
        for clause in toxicity.CLAUSE.split((text or "").lower()):
            words = [lexicon[w] for w in toxicity.WORD.findall(clause)]
            scores += [x] if (x := brute_clause([k for k, _ in words], [w for _, w in words])) else []
        n, total = len(toxicity.WORD.findall((text or "").lower())), sum(scores)
        return [np.log1p(total), max(scores) / 5, np.log1p(len(scores)), 10 * total / (n + 20), np.log1p(sum(x >= 3 for x in scores))] if scores else [0.0] * 5

    by_half, full = [toxicity.Lexicon(learned([h])) for h in (0, 1)], toxicity.Lexicon(learned([0, 1]))
    x = np.array([measured(rows[i], by_half[1 - half[i]]) for i in marks])
    y = np.array([float(marks[i]) for i in marks])
    w = toxicity.logistic(x, y)
    got = {r.doc_id: r.score for r in queries.op6_toxicity(spark, SF).collect()}
    all_marks = Counter(r.toxic for r in table(spark, SF, "labels").collect() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    w[-1] += np.log(all_marks[1] / all_marks[0]) - np.log(y.sum() / (len(y) - y.sum()))
    for i, text in rows.items():
        assert abs(got[i] - 1 / (1 + np.exp(-(np.dot(measured(text, full), w[:-1]) + w[-1])))) < 1e-6


def test_pu_risk_and_gradient_equal_brute_force():
    rng = np.random.default_rng(5)
    p, u, w, prior = rng.normal(size=(7, 3)), rng.normal(size=(11, 3)), rng.normal(size=3), 0.6
    loss = lambda z, y: float(np.log1p(np.exp(-z if y else z)))

    def parts_of(w):
        as_one = prior * sum(loss(float(x @ w), 1) for x in p) / len(p)
        return as_one, sum(loss(float(x @ w), 0) for x in u) / len(u) - prior * sum(loss(float(x @ w), 0) for x in p) / len(p)

    one, zero, up, down = pu_quality.risk(w, p, u, prior)
    assert np.allclose([one, zero], parts_of(w))
    for i in range(3):
        step = np.eye(3)[i] * 1e-6
        slope = (np.array(parts_of(w + step)) - np.array(parts_of(w - step))) / 2e-6
        assert np.allclose([up[i], down[i]], slope, atol=1e-5)


def naive_statistics(text):
    """The twelve shares, counted by hand."""
    words, n = (text or "").split(), len((text or "").split())
    if not n:
        return [0.0] * 11 + [1.0]
    lines = [x for x in text.split("\n") if x.strip()]
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
    share = lambda k: min(1.0, k / n)
    return [
        share(sum(c in "#*$%&<>" for c in text)), sum(w.isupper() for w in words) / n, share(sum(c == "!" for c in text)), sum(words[i] == words[i + 1] for i in range(n - 1)) / n, (1 - len(set(triples)) / len(triples)) if triples else 0.0,
        len(set(words)) / n, min(1.0, (len(text) - n) / n / 20), share(sum(c in "0123456789" for c in text)), 1 - len(set(lines)) / len(lines), min(1.0, np.log(1 + n) / 12), min(1.0, 2 * sum(c == "|" for c in text) / n), 0.0,
    ]


def test_statistics_equal_a_count_by_hand(spark):
    texts = [r.text for r in table(spark, SF, "documents").collect()] + EDGES + ["A | B |\nA | B |\n\nA | B |", "one", "#1! X x X x X x"]
    for t in texts:
        assert np.allclose(pu_quality.statistics(t), naive_statistics(t)), t


def test_the_prior_of_a_known_mixture_is_found():
    """Positives and others from known clouds, mixed in known shares."""
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        draw_from = lambda n, at: rng.normal(at, 1.0, (n, 3))
        u = np.vstack([draw_from(int(3000 * share), 1.5), draw_from(3000 - int(3000 * share), -1.5)])
        assert abs(pu_quality.estimate_prior(draw_from(1500, 1.5), u[rng.permutation(3000)]) - share) < 0.06
    assert pu_quality.estimate_prior(np.zeros((2, 3)), np.zeros((9, 3))) == pu_quality.HIGH_PRIOR


def test_words_and_their_order_count(spark):
    """Of two kinds of texts with equal statistics, words tell them apart; of texts with equal words, pairs do."""
    rng = random.Random(3)
    good, bad = ([f"{k}{i:03d}" for i in range(100)] for k in "gb")
    prose = lambda words: " ".join(rng.choice(words) for _ in range(60))
    phrases = [rng.sample(good, 6) for _ in range(12)]
    ordered = lambda: " ".join(" ".join(rng.choice(phrases)) for _ in range(10))

    def shuffled():
        words = ordered().split()
        rng.shuffle(words)
        return " ".join(words)

    for yes, no in ((lambda: prose(good), lambda: prose(bad)), (ordered, shuffled)):
        texts = [yes() if i % 2 else no() for i in range(800)]
        labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 800) if i % 2 and i % 3], LABELS)
        got = {r.doc_id: r.score for r in pu_quality.score(docs(spark, texts), labels).collect()}
        held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
        right = [(got[i] > 0.5) == bool(i % 2) for i in held]
        assert sum(right) / len(right) > 0.95


def test_quality_equals_brute_force(spark):
    rows = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    learned = sorted(i for i in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    good = {r.doc_id for r in table(spark, SF, "labels").collect() if r.quality == 1}
    half = {r.doc_id: r.h for r in table(spark, SF, "documents").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("h")).collect()}
    sides = {"p": [i for i in learned if i in good], "u": learned}

    def grams(text):
        h = [zlib.crc32(w.encode()) for w in (text or "").split()]
        return [x % 2**15 for x in h], [((a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93) % 2**64 >> 49 for a, b in zip(h, h[1:], strict=False)]

    def table_of(halves, which):
        held = {k: Counter(g for i in ids if half[i] in halves for g in set(grams(rows[i])[which])) for k, ids in sides.items()}
        size = {k: sum(half[i] in halves for i in ids) for k, ids in sides.items()}
        said = lambda g: max(-3.0, min(3.0, np.log((held["p"][g] + 1) / (size["p"] + 2)) - np.log((held["u"][g] + 1) / (size["u"] + 2)))) / 3
        return {g: said(g) for g in held["p"] | held["u"] if held["p"][g] + held["u"][g] >= 3}

    tables = {halves: [table_of(halves, which) for which in (0, 1)] for halves in ((0,), (1,), (0, 1))}

    def full(i, halves):
        means = [np.mean([t.get(g, 0.0) for g in own]) if own else 0.0 for t, own in zip(tables[halves], grams(rows[i]), strict=True)]
        return naive_statistics(rows[i]) + means

    p, u = (np.array([full(i, (1 - half[i],)) for i in sides[k]]) for k in "pu")
    w = pu_quality.nn_pu(p, u, pu_quality.estimate_prior(p, u))
    for r in queries.op3_quality_classifier(spark, SF).collect():
        z = np.dot(full(r.doc_id, (0, 1)), w[:-1]) + w[-1]
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6 and r.predicted == int(r.score >= 0.7)


def test_pu_risk_separates():
    rng = np.random.default_rng(4)
    p, n = rng.normal(1.5, 1, (800, 2)), rng.normal(-1.5, 1, (300, 2))
    u = np.vstack([rng.normal(1.5, 1, (700, 2)), n])[rng.permutation(1000)]
    prior = pu_quality.estimate_prior(p, u)
    assert 0.6 < prior < 0.85
    w = pu_quality.nn_pu(p, u, prior)
    assert ((p @ w[:2] + w[2]) > 0).mean() > 0.9 and ((n @ w[:2] + w[2]) < 0).mean() > 0.8


# -- 4: mixing ---------------------------------------------------------------------------------------


def mixed_source(spark, sizes):
    rows = [(1000 * k + i, "w " * (1 + i % 7), None, name, None, "", "") for k, (name, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_mix_equals_brute_force(spark):
    d = mixed_source(spark, {"a": 900, "b": 150, "c": 60, None: 20})
    rows = mixing.counted(d)
    toks = defaultdict(dict)
    for r in rows.collect():
        toks[r.source][r.doc_id] = r.tokens
    t = {s: sum(x.values()) for s, x in toks.items()}
    total = sum(t.values())
    plan = {r.source: r for r in mixing.planned(rows, 0.95, 4.0, float(total), seed=11).collect()}
    p = {s: v / total for s, v in t.items()}
    weights = lambda a: {s: v**a / sum(x**a for x in p.values()) for s, v in p.items()}
    entropy = lambda w: -sum(v * np.log(v) for v in w.values())
    repeats = lambda w: max(w[s] * total / t[s] for s in t)
    grid = np.linspace(0, 1, 20001)
    flat = max((a for a in grid if entropy(weights(a)) >= 0.95 * np.log(4)), default=0.0)
    least = min(a for a in grid if repeats(weights(a)) <= 4.0)
    want = weights(max(flat, least))
    assert all(abs(plan[s].weight - want[s]) < 2e-4 for s in t)
    drawn = mixing.draw(rows, mixing.planned(rows, 0.95, 4.0, float(total), seed=11), seed=11).collect()
    for s in t:
        got, budget = Counter((r.doc_id, r.epoch) for r in drawn if r.source == s), plan[s].budget
        assert max(got.values()) == 1
        passes = int(budget / t[s] + 1e-9)
        counts = Counter(i for i, _ in got)
        assert all(passes <= counts.get(i, 0) <= passes + 1 for i in toks[s])
        used = sum(toks[s][i] for i, _ in got)
        assert budget - 8 <= used <= budget + 1e-6
        part = [r.draw_at for r in drawn if r.source == s]
        assert 0 <= min(part) and max(part) <= 1 and (len(part) < 50 or abs(np.mean(part) - 0.5) < 0.1)


def test_mix_without_budget_draws_every_document(spark):
    d = mixed_source(spark, {"a": 300, "b": 40, "c": 10})
    got = Counter(r.doc_id for r in mixing.mixed_rows(d, None, 2.0).collect())
    assert set(got) == {r.doc_id for r in d.collect()} and max(got.values()) <= 3
    flat = Counter(r.source for r in mixing.mixed_rows(d, 1.0, None).collect())
    assert flat["c"] > 10 * 5


@pytest.mark.parametrize("few", [True, False])
def test_last_hashes_equal_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rng = random.Random(4)
    rows = [(s, rng.randint(0, 9), rng.choice([rng.randrange(1 << 53), rng.randrange(1 << 20), 77, (1 << 53) - 1]), i) for i, s in enumerate("abc" * 400)]
    rests = {"a": 900.0, "b": 3.5, "c": 1e9}
    want = {}
    for s, rest in rests.items():
        own = sorted((h, t) for x, t, h, _ in rows if x == s)
        want[s] = max((h for h, _ in own if sum(t for k, t in own if k <= h) <= rest), default=-1)
    df = spark.createDataFrame(rows, "source string, tokens long, h long, doc_id long")
    got = {r.source: r.cut for r in mixing.last_hashes(df, spark.createDataFrame(list(rests.items()), "source string, rest double")).collect()}
    assert set(got) == set(rests)
    for s in rests:  # the same documents are taken, wherever between two hashes the cut stands
        assert {h for x, _, h, _ in rows if x == s and h <= got[s]} == {h for x, _, h, _ in rows if x == s and h <= want[s]}


# -- 5: near-duplicates ------------------------------------------------------------------------------


def grams(t):
    w = (t or "").lower().split()
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute_classes(texts, doc_ids=None):
    """Class of each key of `texts`; keys that share a doc_id are one document."""
    sets = {i: grams(t) for i, t in texts.items()}
    size = {i: c.total() for i, c in sets.items()}
    doc_ids = doc_ids or {i: i for i in texts}
    root = {i: i for i in doc_ids.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if min(size[a], size[b]) < 0.8 * max(size[a], size[b]):
                continue
            both = sum(min(c, sets[b][g]) for g, c in sets[a].items())
            if both and both >= 0.8 * (size[a] + size[b] - both):
                x, y = sorted((find(doc_ids[a]), find(doc_ids[b])))
                root[y] = x
    return {i: find(i) for i in set(doc_ids.values())}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "one", "one", "One ", "two three", "w " * 50]
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(rng.choice([2, 5, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(base) // 40)])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(40)]
    got = {r.doc_id: r.class_id for r in dedup.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_classes(dict(enumerate(texts)))


def test_near_duplicates_of_documents(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert {r.doc_id: r.class_id for r in queries.op5_minhash_near_dedup(spark, SF).collect()} == brute_classes(texts)


def test_ids_with_several_texts_are_one_document(spark):
    rng = random.Random(5)
    a, b, c = ([f"{k}{rng.randrange(400)}" for _ in range(80)] for k in "abc")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, near(b)), (6, near(a)), (7, " ".join(c)), (8, near(c)), (9, "alone"), (None, " ".join(a)), (8, near(c)), (9, None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.class_id for r in dedup.near_duplicates(df).collect()}
        assert got == {1: 1, 5: 1, 6: 1, 7: 7, 8: 7, 9: 9, None: None}
        kept = sorted(((r.doc_id or 0, r.text or "") for r in dedup.keep_one(df).collect()))
        assert kept == sorted([(0, " ".join(a)), (1, min(" ".join(a), " ".join(b))), (7, " ".join(c)), (9, "")])


@pytest.mark.parametrize("weighting", ["count", "set"])
def test_element_sets_equal_shingle_counts(weighting):
    rng = random.Random(2)
    texts = [*EDGES, *[" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(200)]]
    hashes = dedup.WordHashes()
    sets = dedup.element_sets(texts, hashes, weighting)
    weigh = (lambda c: c) if weighting == "count" else (lambda c: Counter(dict.fromkeys(c, 1)))
    counts = [weigh(grams(t)) for t in texts]
    assert all(np.array_equal(x, dedup.elements_of(t, hashes, weighting)) for t, x in zip(texts, sets, strict=True))
    for i, j in zip(range(0, 200, 2), range(1, 200, 2), strict=True):
        assert dedup.common(sets[i], sets[j]) == (counts[i] & counts[j]).total() and len(sets[i]) == counts[i].total()
    assert dedup.element_sets([], hashes) == []


def test_repeated_shingles_weigh_as_often_as_they_occur(spark):
    line = "a line of ten words that comes again and again"
    texts = {0: " ".join([line] * 20), 1: " ".join([line] * 18), 2: " ".join([line] * 9), 3: line}
    assert dedup.similarity(texts[0], texts[1]) >= 0.8 > dedup.similarity(texts[0], texts[2])
    got = {r.doc_id: r.class_id for r in dedup.near_duplicates(docs(spark, list(texts.values()))).collect()}
    assert got == brute_classes(texts) == {0: 0, 1: 0, 2: 2, 3: 3}


@pytest.mark.parametrize("rows", [1, 10_000])
def test_hot_keys_change_no_class(spark, monkeypatch, rows):
    monkeypatch.setattr(dedup, "HOT_ROWS", rows)
    monkeypatch.setattr(dedup, "HOT_KEYS", 3)
    rng = random.Random(7)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    texts = [" ".join(base)] * 20 + [" ".join([*base[:k], f"n{k}", *base[k + 1 :]]) for k in range(60)] + [None, "", "own words here"]
    got = {r.doc_id: r.class_id for r in dedup.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_classes(dict(enumerate(texts)))


def family(rng, members, planted, passage, own, extra):
    """Texts of one passage and own words; each of the planted pairs has `extra` of these in common."""
    texts, words = [], (f"u{i}" for i in range(10**9))
    shared = [f"p{i}" for i in range(passage)]
    for k in range(members):
        both = [next(words) for _ in range(extra)] if k < planted else []
        for _ in range(2 if k < planted else 1):
            texts.append(" ".join(both + shared + [next(words) for _ in range(own - len(both))]))
    order = list(range(len(texts)))
    rng.shuffle(order)
    at = {old: new for new, old in enumerate(order)}
    pairs = {tuple(sorted((at[2 * k], at[2 * k + 1]))) for k in range(planted)}
    return [texts[i] for i in order], pairs


def test_pairs_of_a_large_family_are_found(spark):
    texts, pairs = family(random.Random(11), 1200, 60, 150, 24, 8)
    a, b = min(pairs)
    c = next(i for i in range(len(texts)) if not any(i in p for p in pairs))
    assert dedup.similarity(texts[a], texts[b]) >= 0.8 > dedup.similarity(texts[a], texts[c]) > 0.7
    got = {r.doc_id: r.class_id for r in dedup.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: i for i in range(len(texts))} | {j: i for i, j in pairs}


@pytest.mark.parametrize("limit", [1, 16])
def test_exact_join_finds_all_classes(spark, limit):
    rng = random.Random(limit)
    texts = {}
    for f in range(3):
        passage = [f"f{f}w{i}" for i in range(60)]
        for _ in range(40):
            cut = rng.choice([0, 0, 0, 2, 5])
            tail = [rng.choice("abcdefgh") + str(f) for _ in range(rng.choice([0, 2, 6, 10, 14]))]
            texts[len(texts)] = " ".join(passage[cut:] + tail)
    texts = {i: t for i, t in texts.items() if t not in [texts[j] for j in range(i)]}
    nodes = spark.createDataFrame([(i, i) for i in texts], "node long, root long")
    rows = spark.createDataFrame(list(texts.items()), "node long, text string")
    links = dedup.compare(dedup.similar_pairs(nodes, rows, limit=limit), rows)
    got = {i: i for i in texts} | {r.node: r.root for r in dedup.components(links.select("a", "b")).collect()}
    assert got == brute_classes(texts)


def test_exact_join_compares_few_pairs_of_a_large_family(spark):
    """Texts at 0.75 that share their whole passage: all pairs are alike, but few are worth a look."""
    texts, pairs = family(random.Random(5), 3000, 40, 150, 24, 8)
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    with dedup.Temporary(spark):
        found = {(r.a, r.b) for r in dedup.similar_pairs(rows.select("node", dedup.F.col("node").alias("root")), rows).collect()}
    assert pairs <= found and len(found) < 10 * len(texts)


def test_exact_join_of_mixed_passages(spark):
    """Every text is a choice of passages that many others have too, so that all shingles are hot; classes as by all pairs."""
    rng = random.Random(8)
    passages = [[f"m{k}w{i}" for i in range(30)] for k in range(14)]
    texts = {n: " ".join(w for k in sorted(rng.sample(range(14), 9)) for w in passages[k]) + f" {'x' * (n % 3)}" for n in range(150)}
    texts = {n: t for n, t in texts.items() if t not in [texts[m] for m in range(n)]}
    nodes = spark.createDataFrame([(i, i % 40) for i in texts], "node long, root long")
    rows = spark.createDataFrame(list(texts.items()), "node long, text string")
    links = dedup.compare(dedup.similar_pairs(nodes, rows, limit=2), rows)
    # Nodes of one root are one class from the start.
    roots = links.select("a", "b").unionByName(nodes.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b and a < 1000"))
    got = {r.node: r.root for r in dedup.components(roots).collect()}
    parent = {i: i for i in texts} | {i % 40: i % 40 for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in texts.items()}
    for i in texts:
        parent[max(top(i), top(i % 40))] = min(top(i), top(i % 40))
        for j in texts:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    assert {i: got.get(i, i) for i in parent} == {i: top(i) for i in parent}


@pytest.mark.parametrize("n", [300_000])
def test_two_long_near_texts(spark, n):
    """Texts of so many different words, just above and just below the bar; nothing holds a text's shingles in one row twice."""
    words = [f"w{i}" for i in range(n)]
    near, far = list(words), list(words)
    for i in range(0, n, 50):
        near[i] = f"n{i}"  # each changes 5 of 50 shingles: 0.9 / 1.1
    for i in range(0, n, 45):
        far[i] = f"f{i}"  # 40 / 50
    for i in range(7, n, 900):
        far[i] = f"g{i}"
    got = {r.doc_id: r.class_id for r in dedup.near_duplicates(docs(spark, [" ".join(t) for t in (words, near, far)])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    kept = dedup.keep_one(docs(spark, [" ".join(t) for t in (words, near)]).withColumn("extra", F.create_map(F.lit("k"), F.col("doc_id"))))
    assert [r.doc_id for r in kept.collect()] == [0]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(6)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    for wide in (0.7, 3.0):
        a, b = rng.random(300) * wide + 0.01, rng.random(300) * wide + 0.01
        s = dedup.signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 4096)
        assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}


# -- 7: rules ----------------------------------------------------------------------------------------


def test_rules_equal_sql(spark, duck):
    r = duck.execute(quality_rules.SQL)
    same(queries.op7_quality_rules(spark, SF), [d[0] for d in r.description], r.fetchall())


def test_rule_order_never_changes_a_verdict(spark):
    d = table(spark, SF, "documents")
    one, two = ({r.doc_id: r.kept for r in quality_rules.apply_rules(d, rules).collect()} for rules in (quality_rules.RULES, quality_rules.RULES[::-1]))
    assert one == two and set(one.values()) == {True, False}
    assert set(quality_rules.cascade_order(d)) == set(quality_rules.RULES)


def test_repeated_windows_by_hand():
    words = b"a b c d a b c x a b c".split()
    assert quality_rules.repeated_window_words(words) == 9
    assert quality_rules.repeated_window_words(b"a a a a".split()) == 4 and quality_rules.repeated_window_words(b"a b".split()) == 0


# -- 8: top-k ----------------------------------------------------------------------------------------


def test_top_k_equals_sql(spark, duck):
    r = duck.execute(topk.SQL)
    same(queries.op8_exact_top_k(spark, SF), [d[0] for d in r.description], r.fetchall())


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [-1.0]), (None, [9.0, 9.0]), (50, [0.0, 0.0]), (0, [2.0, 0.5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, EMBEDDING string, uid int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 3).collect())
    one, two = 256 * 256 + 128 * 128, 512 * 256 + 128 * 128
    first = [(0, 1, 0, two), (0, 2, 1, one), (0, 3, 2, one)]  # of the row (1, 0.5)
    second = [(0, 1, 0, two), (0, 2, 1, two), (0, 3, 2, two)]  # of the other row with id 0
    assert got == sorted(first + second) + [(50, 1, 0, 0), (50, 2, 0, 0), (50, 3, 1, 0)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [])], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def brute_top(rows, ids, queries, k):
    """The k best of each query position in Python's integers."""
    product = rows[queries].astype(object) @ rows.T.astype(object)
    others = lambda i: sorted((j for j in range(len(rows)) if j != queries[i]), key=lambda j: (-product[i, j], ids[j]))[:k]
    return [[(ids[j], int(product[i, j])) for j in others(i)] for i in range(len(queries))]


@pytest.mark.parametrize("kind", ["dense", "huge", "uneven", "ties"])
def test_max_score_equals_products(kind):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(900, 12)) * 50
    m = {"dense": m, "huge": m * 1e7, "uneven": m * 2.0 ** -np.arange(12), "ties": np.sign(m)}[kind].astype(np.int64)
    ids, queries = rng.permutation(450).repeat(2), np.array([3, 5, 7, 100, 899])
    search = topk.Search(queries, m[queries], np.full(5, topk.LEAST), 5)
    for lo in range(0, 900, 128):
        search.meet(m[lo : lo + 128], np.arange(lo, min(900, lo + 128)), ids[lo : lo + 128])
    got = list(zip(*(x.tolist() for x in search.found), strict=True))
    assert [[(v, s) for q, s, v in got if q == i] for i in range(5)] == brute_top(m, ids.tolist(), queries, 5)


def test_rounds_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROUND_BYTES", 8 * 64 * 3)
    rows = table(spark, SF, "embeddings")
    every = lambda: sorted(tuple(r) for r in topk.top_k(rows, F.col("vec_id") % 50 == 0).collect())
    several = every()
    monkeypatch.undo()
    assert several == every() and len(several) > 0


# -- 10: sharding ------------------------------------------------------------------------------------


def test_shards_equal_xxhash(spark):
    xxhash = pytest.importorskip("xxhash")

    def mixed(*values):
        seed = 42
        for v, width in values:
            seed = xxhash.xxh64(int(v).to_bytes(width, "little", signed=True), seed=seed).intdigest()
        return seed

    def distance(key, shard):
        bits = mixed((key, 8), (0, 4), (shard, 4)) >> 11
        return -np.log((bits + 0.5) * 2.0**-53)

    for r in queries.op10_sharding(spark, SF).collect():
        d = [distance(r.doc_id, s) for s in range(25)]
        assert r.shard == int(np.argmin(d[:24])) and r.grown_shard == int(np.argmin(d))


def test_slots_and_sizes(spark):
    d = docs(spark, EDGES + ["dup"] * 3)
    d = d.union(d.where("doc_id = 7")).union(d.where("doc_id = 7"))
    rows = sharding.shard_records(d, "doc_id", "text", [1.0, 2.0, 1.0]).collect()
    assert len(rows) == len(EDGES) + 5
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        text = (EDGES + ["dup"] * 3)[r.doc_id] or ""
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_weights_rule_shares(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = Counter(r.shard for r in sharding.shard_records(d, "doc_id", "text", [1.0, 3.0]).collect())
    assert 0.72 < n[1] / 4000 < 0.78
    with pytest.raises(ValueError, match="positive"):
        sharding.shard_records(d, "doc_id", "text", [1.0, 0.0])


# -- pipeline ----------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = table(spark, SF, "documents")
    before = d
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, corpus_pipeline.materialize(stage(spark, d, SF), name)
        kept[name] = Counter(r.doc_id for r in d.collect())
        if name != "byte_bpe":
            assert d.columns == before.columns
    verdict = {r.doc_id for r in quality_rules.apply_rules(table(spark, SF, "documents")).where("kept").collect()}
    assert set(kept["quality_rules"]) == verdict
    assert set(kept["language_id"]) <= verdict and len(kept["language_id"]) > 0.97 * len(verdict)
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect() if r.doc_id in kept["language_id"]}
    assert set(kept["minhash_near_dedup"]) == set(brute_classes(texts).values()) and max(kept["minhash_near_dedup"].values()) == 1
    assert set(kept["mixing"]) == set(kept["minhash_near_dedup"]) and max(kept["mixing"].values()) <= 2
    assert kept["byte_bpe"] == kept["mixing"]
    for r in d.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_language_stage_drops_wrong_labels(spark):
    import corpus_pipeline

    d = table(spark, SF.replace("0.001", "0.01"), "documents")
    by = {x: [r.text for r in d.where(F.col("lang") == x).orderBy("doc_id").limit(60).collect()] for x in ("en", "de")}
    rows = [(i + 1000 * (x == "de"), t, x) for x in by for i, t in enumerate(by[x])]
    half = by["en"][0][:400] + " " + by["de"][0][:400]
    rows += [(5000, by["de"][1], "en"), (5001, half, "en"), (5002, half, None), (5003, by["de"][1], "xx"), (5004, "12 34 56", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language_id.keep_known(docs, language_id.fit(docs.where("doc_id < 5000")), least=corpus_pipeline.DECLARED, declared="lang").collect()}
    assert kept & {5000, 5001, 5002, 5003, 5004} == {5002, 5003} and len(kept) > 100
    stage = corpus_pipeline.language_stage(spark, docs.where("lang is null or lang <> 'xx'"), SF)
    assert 5000 not in {r.doc_id for r in stage.collect()} and stage.columns == docs.columns


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    prose = [r.text for r in quality_rules.keep_good(table(spark, SF, "documents")).limit(6).collect()]
    long = " ".join(f"{w}{i}" for i in range(400) for w in prose[0].split()[:40])
    texts = [*EDGES, *prose, prose[0], long]
    rows = [(i, t, "en" if i % 3 else None, ["s", "t", None][i % 3], None, "other", "clash") for i, t in enumerate(texts)]
    rows += [rows[12], (None, prose[1], "en", "s", None, None, None), (None, None, None, None, None, None, None)]
    odd = spark.createDataFrame(rows, DOCS)
    d = odd
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), SF).count() == 0
        out = stage(spark, d, SF)
        if name == "byte_bpe":
            assert {r.decoded_sha256 for r in out.collect()} == {hashlib.sha256((r.text or "").encode()).hexdigest() for r in d.collect()}
            break
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
        kept = [tuple(r) for r in out.collect()]
        assert set(kept) <= set(rows) and kept
        d = spark.createDataFrame(kept, DOCS)
        if name == "minhash_near_dedup":
            assert Counter(r[0] for r in kept if r[0] is not None).most_common(1)[0][1] == 1 and long in {r[1] for r in kept}


def test_registry():
    assert [n for n in queries.QUERIES] == [f.__name__ for f in queries.QUERIES.values()] and len(queries.QUERIES) == 10
    assert json.dumps(sorted(queries.ORACLE_SQL)) == '["op1_chat_formatting", "op7_quality_rules", "op8_exact_top_k"]'
