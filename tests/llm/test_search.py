"""Fingerprints, URL rules, decontamination, secrets and toxicity against brute force."""

import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from samples import awkward, documents, frame, prose, with_clashes

from starcast.llm import common, decontamination, fingerprints, secrets, toxicity, url_filters


def parsed(fingerprint):
    return [(h, int(p)) for h, p in (entry.split(":") for entry in fingerprint.split(","))] if fingerprint else []


def expected_edits(rows):
    order = sorted({(row[0], row[1] or "") for row in rows}, key=lambda d: -d[0])
    result = {}
    for i, (doc_id, text) in enumerate(order):
        n = len(text) // 3
        result[doc_id] = text[: len(text) - n] + order[(i + 1) % len(order)][1][:n]
    return order, result


def test_fingerprints(spark, docs):
    rows = {r.doc_id: r for r in fingerprints.edit_report(docs).collect()}
    order, edited = expected_edits(documents())
    texts = dict(order)
    assert set(rows) == set(texts)
    for i, (doc_id, text) in enumerate(order):
        r, after = rows[doc_id], rows[order[(i + 1) % len(order)][0]]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited[doc_id].encode()).hexdigest()
        own, other, following = ({h for h, _ in parsed(f)} for f in (r.fingerprint, r.edited_fingerprint, after.fingerprint))
        assert r.near_edited == pytest.approx(len(own & other) / len(own | other) if own | other else 1.0)
        assert r.near_next == pytest.approx(len(own & following) / len(own | following) if own | following else 1.0)
        same = [d for d, t in order if t == text]
        assert all(rows[d].fingerprint == r.fingerprint for d in same)


def test_winnowing_selects_the_rightmost_minimum_of_each_window(spark, docs):
    hashes = F.expr(
        "transform(sequence(0, size(words) - 4), i -> shiftrightunsigned("
        "xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3]), 25))"
    )
    df = docs.select("doc_id", fingerprints.fingerprint(fingerprints.selected(F.col("text"))).alias("f"), "text")
    df = df.withColumn("words", F.expr(r"regexp_extract_all(text, '(?<!\\S)\\S{1,32}(?!\\S)|\\S', 0)"))
    for r in df.where("size(words) >= 4").withColumn("hashes", hashes).collect():
        chosen = []
        for start in range(max(1, len(r.hashes) - 7)):
            window = r.hashes[start : start + 8]
            at = start + max(i for i, h in enumerate(window) if h == min(window))
            if at not in chosen:
                chosen.append(at)
        assert parsed(r.f) == [(f"{r.hashes[i]:010x}", i) for i in chosen]


def test_fingerprints_do_not_depend_on_where_a_run_starts(spark):
    rng = random.Random(5)
    alphabets = {1: range(0x4E00, 0x5600), 2: range(0x61, 0x7B), 3: range(0x1F300, 0x1F5F0)}
    texts = {n: "".join(chr(rng.choice(letters)) for _ in range(3000)) for n, letters in alphabets.items()}
    rows = [(n, t, front + t) for n, t in texts.items() for front in ("x", "xyz" * 11, "x y ")]
    df = spark.createDataFrame(rows, "n long, text string, shifted string")
    chosen = [fingerprints.selected(F.col(c)) for c in ("text", "shifted")]
    assert all(r.near > 0.98 for r in df.select(fingerprints.likeness(*chosen).alias("near")).collect())
    # A run of 32 characters is one token, one of 33 is as many as it has characters.
    sizes = spark.createDataFrame([("a" * 32,), ("a" * 33,)], "text string").select(
        F.size(fingerprints.selected(F.col("text"), 1, 1)).alias("n")
    )
    assert [r.n for r in sizes.collect()] == [1, 33]


@pytest.mark.parametrize("name", ["odd", "clashing"])
def test_fingerprints_of_odd_rows(request, name):
    rows = fingerprints.edit_report(request.getfixturevalue(name)).collect()
    count = collections.Counter((r.doc_id, r.n_chars) for r in rows)
    assert count == collections.Counter((row[0], len(row[1] or "")) for row in awkward())
    copies = {r.fingerprint for r in rows if r.n_chars == len(awkward()[0][1])}
    assert len(copies) == 1
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].fingerprint == "" and by_id[4].edited_sha256 == hashlib.sha256(b"").hexdigest()
    n = len(awkward()[10][1]) // 3
    assert by_id[7].edited_sha256 == hashlib.sha256((awkward()[10][1][:-n] + "x" * n).encode()).hexdigest()


def test_single_document_follows_itself(spark):
    text = "a b c d e f g h i j k l m n o p"
    r = fingerprints.edit_report(frame(spark, [(1, text, None, None, None)])).first()
    n = len(text) // 3
    assert r.edited_sha256 == hashlib.sha256((text[:-n] + text[:n]).encode()).hexdigest() and r.near_next == 1.0


URLS = [
    "http://Example.ORG/es/x?y", "https://a.b.example.org/es/", "https://example.org/en/1", "https://example.org/en/15#t",
    "https://example.org/en/25", "https://org/", "https://org", "https://forg/es/", "http://x.com/fr/1", "http://x.com/de/1",
    "http://com/it/", "//example.org/es/", None, "", "http://", "http:///fr/", "http://x.com:80/fr/", "mailto:a://b.com/de/z",
    "http://x.org//example.org/es/", "http://é.com/de/ü?", "http://..com/de/",
]


def expected_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if c < "\x80" else c for c in rest[:end]), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fitting = [
        (-len(h + p), h + p, v) for h, p, v in rules
        if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return host, path, *(min(fitting)[1:] if fitting else (None, "allow"))


def test_urls(spark):
    from starcast.llm.queries import URL_RULES

    rules = [*URL_RULES, ("x.com", "/fr", "block"), ("x.com", "", "block"), (None, "/", "block"), ("b.org", None, "allow")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string")
    for own in (rules, URL_RULES, []):
        found = url_filters.judge(pages, spark.createDataFrame(own, url_filters.RULES)).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == {
            i: expected_verdict(u, own) for i, u in enumerate(URLS + URLS)
        }
    assert url_filters.judge(pages.limit(0), spark.createDataFrame(rules, url_filters.RULES)).count() == 0


def least_distance(pattern, text):
    """The least edit distance between the pattern and any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != p)))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        chars[at : at + 1] = rng.choice([[], ["#"], [chars[at], "#"]])
    return "".join(chars)


def contaminated(rng):
    items = [(i, prose(rng, rng.randint(12, 30), 4000)) for i in range(8)] + [(8, "tiny"), (9, "twelve chars"), (10, ""), (11, None)]
    items.append((12, items[0][1]))
    rows = []
    for i in range(60):
        text = prose(rng, 40, 4000)
        if i % 3:
            item = items[i % 8][1]
            n = rng.randint(0, len(item) // 7)
            text = text[: i * 3] + "\n" + edited(rng, item.upper(), n) + "  " + text[i * 3 :]
        if i % 10 == 0:
            text += " so tiny a text of twelve  chars"
        rows.append((i, text, None, None, None))
    return items, rows


def test_items_within_their_edit_budget_are_found(spark):
    items, rows = contaminated(random.Random(5))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, rows)
    found = {r.doc_id: [tuple(x) for x in r.llm_items] for r in decontamination.with_matches(df, benchmark).collect()}
    n_edited = 0
    for doc_id, text, *_ in rows:
        text, expected = decontamination.normalized(text), []
        for i, item in items:
            item = decontamination.normalized(item or "")
            budget = decontamination.edit_budget(len(item)) if len(item) >= decontamination.Q else 0
            if item and (d := least_distance(item, text)) <= budget:
                expected.append((i, d))
                n_edited += d > 0
        assert found[doc_id] == expected, doc_id
    assert n_edited > 20


def test_items_in_blocks_and_texts_in_pieces(spark, monkeypatch):
    items, rows = contaminated(random.Random(5))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = decontamination.Index([(i, decontamination.normalized(t)) for i, t in items if t])
    texts = [row[1] for row in rows]
    expected = whole.matches(texts)
    monkeypatch.setattr(decontamination, "PIECE_CHARS", 150)
    assert whole.matches(texts) == expected
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 100)
    assert len(list(decontamination.item_blocks(benchmark))) > 3
    found = decontamination.with_matches(frame(spark, rows), benchmark).collect()
    assert {r.doc_id: [tuple(x) for x in r.llm_items] for r in found} == {row[0]: e for row, e in zip(rows, expected)}


@pytest.mark.parametrize("name", ["odd", "clashing"])
def test_matches_in_odd_rows(spark, request, name):
    df = request.getfixturevalue(name)
    benchmark = spark.createDataFrame([(1, awkward()[0][1][10:200]), (None, "no item"), (2, None)], "item_id long, text string")
    found = decontamination.with_matches(df, benchmark)
    assert found.columns == [*df.columns, "llm_items"]
    hits = [r.doc_id for r in found.collect() if r.llm_items]
    assert sorted(hits, key=repr) == sorted([1, 1, 2, None], key=repr)
    assert all(r.llm_items == [] for r in decontamination.with_matches(df, benchmark.limit(0)).collect())


SECRETS = [
    'password = "hunter22hunter"', "API_KEY:abcdefgh", "apikey=short", "token: secret: abcdefghij", "Secret='x/y+z=._-1'",
    "AKIAABCDEFGHIJKL", "AKIASHORT", "xAKIA0123456789AB1z", "deadbeef" * 4, "deadbeef" * 3, "token = " + "0123456789abcdef" * 3,
    "ſecret=abcdefghijk", "toKen=abcdefghijk", "passwd=éabcdefghij", "éé token\t=abcdefghij password=abcdefgh",
]


def expected_base(text):
    """The base matches by a direct scan from left to right."""
    found = []
    allowed = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    lowered = "".join(c.lower() if c < "\x80" else c for c in text)

    def run(start, chars):
        end = start
        while end < len(text) and text[end] in chars:
            end += 1
        return end

    at = 0
    while at < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if lowered.startswith(w, at)), None)
        end = None
        if word:
            p = at + len(word)
            p += p < len(text) and text[p] in "\"'"
            p = run(p, " ")
            if p < len(text) and text[p] in ":=":
                p = run(p + 1, " ")
                p += p < len(text) and text[p] in "\"'"
                end = run(p, allowed)
                if end > p:
                    if end - p >= 8:
                        found.append((at, 0, "assign", end))
                else:
                    end = None
        at = end or at + 1
    for kind, (name, head, chars, least) in enumerate(
        [("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), ("hex", "", "0123456789abcdef", 32)], 1
    ):
        at = 0
        while at < len(text):
            end = run(at + len(head), chars) if text.startswith(head, at) else at
            if end > at + len(head):
                if end - at >= least:
                    found.append((at, kind, name, end))
                at = end
            else:
                at += 1
    return [(name, start, end) for start, _, name, end in sorted(found)]


def test_base_secrets(spark):
    rng = random.Random(1)
    texts = SECRETS + [" ".join(rng.sample(SECRETS, 4)) for _ in range(40)] + ["".join(rng.sample(SECRETS, 3)) for _ in range(40)]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    for r in secrets.report(df).collect():
        base = expected_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[r.doc_id]
        kinds = collections.Counter(k for k, _, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert [s for s in r.spans.split(",") if s and not s.startswith("grammar")] == [s for s in joined.split(",") if s]


def test_learned_format(spark):
    rng = random.Random(4)

    def credential(n=40):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    rows = [(i, f"{prose(rng, 20)} some quiet ordinary language token = \"{credential()}\" end", None, None, None) for i in range(60)]
    rows += [(100 + i, f"unlike others {credential(30)}: here", None, None, None) for i in range(20)]
    rows += [(200 + i, "an internationalisation of chapter/section-one/paragraph.2 and word_word_word_word1", None, None, None) for i in range(20)]
    found = {r.doc_id: r for r in secrets.report(frame(spark, rows)).collect()}
    assert all(found[100 + i].n_grammar == 1 and found[100 + i].spans == "grammar:14:44" for i in range(20))
    assert all(found[200 + i].n_grammar == 0 for i in range(20))
    assert all(found[i].n_assign == 1 and found[i].n_hex == 1 for i in range(60))


def test_automaton_merges_compatible_states():
    rng = random.Random(0)
    # a(bb)*c: the distribution has three states.
    words = ["a" + "11" * int(rng.expovariate(0.5)) + "-" for _ in range(3_000)]
    automaton = secrets.Automaton(words)
    reached, todo = set(), [0]
    while todo:
        state = todo.pop()
        if state not in reached:
            reached.add(state)
            todo += automaton.next[state].values()
    assert len(reached) <= 6
    assert automaton.bits("a1111-") > automaton.bits("a111-") and automaton.bits("a-") > automaton.bits("-a")


@pytest.mark.parametrize("name", ["odd", "clashing", "none"])
def test_secrets_in_odd_rows(request, name):
    df = request.getfixturevalue(name)
    rows = secrets.report(df).collect()
    assert len(rows) == df.count() and all(r.spans == "" for r in rows)


def labelled_documents(rng, n=600):
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 80)).split()
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vileness", "vilest,", "Nasty!", "nastiness"])
        rows.append((i, " ".join(words), None, None, None))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled_documents(random.Random(9))
    df, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.with_scores(df, known, ~toxicity.held_out()).withColumn("held", toxicity.held_out()).collect()
    held = [(r.llm_score, labels[r.doc_id][2]) for r in found if r.held]
    assert len(held) > 80 and all(0 <= s <= 1 and (s >= 0.5) == (y == 1) for s, y in held)
    evidence = next(r.llm_evidence for r in found if labels[r.doc_id][2])
    assert evidence and all(0 < e.cosine <= 1 + 1e-6 for e in evidence)
    # A held-out label changes no score.
    flipped = spark.createDataFrame(
        [(i, q, 1 - t if r.held else t) for (i, q, t), r in zip(labels, sorted(found, key=lambda r: r.doc_id))],
        known.schema,
    )
    again = toxicity.with_scores(df, flipped, ~toxicity.held_out()).collect()
    assert {r.doc_id: r.llm_score for r in again} == {r.doc_id: r.llm_score for r in found}


def test_neighbours_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    names = [f"f{i:02}" for i in range(40)]
    import pandas as pd

    examples = [(" ".join(rng.choice(names, rng.integers(1, 9))), int(rng.integers(0, 2))) for _ in range(500)]
    df = collections.Counter(f for text, _ in examples for f in set(text.split()))
    index = toxicity.build(examples, pd.DataFrame({"feature": names, "df": [df[f] for f in names]}), 15)
    counts = toxicity.Counts(index.known)
    vectors = []
    for text, _ in examples:
        v = np.zeros(len(names))
        features, weights = index.vector(counts(text))
        v[features] = weights
        vectors.append(v)
    for query in vectors[:60]:
        text = " ".join(n for n, w in zip(names, query) if w)
        features, weights = index.vector(counts(text))
        v = np.zeros(len(names))
        v[features] = weights
        best = sorted(((-round(float(v @ x), 9), i) for i, x in enumerate(vectors) if v @ x > 0))[:15]
        found = index.nearest(counts(text), 15)
        assert [i for i, _ in found] == [i for _, i in best]


def test_few_labelled_rows_have_neighbours(spark):
    """About 70 labelled rows: too few for any test of features, so the cosine must take all words."""
    rows, labels = labelled_documents(random.Random(4), 90)
    df, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.with_scores(df, known, ~toxicity.held_out()).withColumn("held", toxicity.held_out()).collect()
    held = [r for r in found if r.held]
    assert 60 < len(found) - len(held) < 80
    assert all(len(r.llm_evidence) == toxicity.K for r in found)
    toxic, clean = ([r.llm_score for r in held if labels[r.doc_id][2] == t] for t in (1, 0))
    assert toxic and sum(toxic) / len(toxic) > sum(clean) / len(clean)
    # Against brute force over the vectors of whole texts.
    texts = {r[0]: collections.Counter() for r in rows}
    for doc_id, text, *_ in rows:
        for word in text.lower().split():
            texts[doc_id].update(toxicity.features_of(word))
    training = [r.doc_id for r in found if not r.held]
    df_of = collections.Counter(f for d in training for f in texts[d])
    idf = {f: np.log(1 + len(training) / n) for f, n in df_of.items()}

    def vector(counts):
        own = {f: (1 + np.log(n)) * idf[f] for f, n in counts.items() if f in idf}
        length = np.sqrt(sum(w * w for w in own.values()))
        return {f: w / length for f, w in own.items()}

    vectors = {d: vector(c) for d, c in texts.items()}
    for r in held:
        own = vectors[r.doc_id]
        best = sorted((sum(w * vectors[d].get(f, 0) for f, w in own.items()) for d in training), reverse=True)
        assert [e.cosine for e in r.llm_evidence] == pytest.approx(best[: toxicity.K], abs=1e-8)


@pytest.mark.parametrize("name", ["odd", "clashing"])
def test_toxicity_of_odd_rows(spark, request, name):
    df = request.getfixturevalue(name)
    kind = "doc_id long, quality int, toxic int"
    for labels in ([], [(1, 1, 1), (1, 0, 0), (2, None, None), (None, 1, 1), (7, 1, 0), (99, 1, 1)]):
        found = toxicity.with_scores(df, spark.createDataFrame(labels, kind))
        assert found.columns == [*df.columns, "llm_score", "llm_evidence"]
        rows = found.collect()
        assert len(rows) == len(awkward()) and all(0 <= r.llm_score <= 1 for r in rows)


def test_empty_tables(spark, none):
    assert fingerprints.edit_report(none).count() == 0
    benchmark = spark.createDataFrame([(1, "a passage of a benchmark")], "item_id long, text string")
    assert decontamination.with_matches(none, benchmark).count() == 0
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.with_scores(none, labels).count() == 0


def test_toxicity_looks_up_no_beginning_after_one_that_is_unknown():
    examples = ["boundless abcd- (abcde) ab- ABCDEFGHIJ", "bound, bounded"]
    names = sorted({name for text in examples for word in text.lower().split() for name in toxicity.features_of(word)})
    asked = []

    class Known(dict):
        def get(self, key):
            asked.append(key)
            return super().get(key)

    counts = toxicity.Counts(Known((name, i) for i, name in enumerate(names)))
    words = ["boundary", "abcdefghijk", "abcx", "abc-", "abcd-", "zzzzzzzzz", "ab", "a", "()", "bounds!"]
    for word in words:
        assert list(counts.words[word]) == [names.index(name) for name in toxicity.features_of(word) if name in names]
    assert [key for key in asked if key.startswith("z")] == ["zzz-"]
    features, times = counts("Bounds bounds zzzzzzzzz ab")
    assert [(names[f], t) for f, t in zip(features, times)] == [("bou-", 2), ("boun-", 2), ("bound-", 2)]


def test_names_of_an_index_take_few_bytes_and_no_text():
    import pickle

    words = ["boundless", "bounded", "abcde", "ab", "()", "a!", "zzz", "boundary", "abcd", "\u00dcberma\u00df", ""]
    names = sorted({name for word in words[:6] + words[-2:] for name in toxicity.features_of(word.lower())})
    plain = toxicity.Counts({name: i for i, name in enumerate(names)})
    small = toxicity.Counts(toxicity.Names(names))
    for text in [*words, " ".join(words), "boundless Boundless, bounds ab ab", ""]:
        assert [part.tolist() for part in small(text)] == [part.tolist() for part in plain(text)]
    assert toxicity.Counts(toxicity.Names([]))("bounds")[0].tolist() == []
    many = [f"name-{i}" for i in range(20_000)]
    index = toxicity.gather([(name, i % 2) for i, name in enumerate(many)], pd.DataFrame({"feature": many, "df": 1}), {})
    assert isinstance(index.known, toxicity.Names)
    assert index.known.hashes.nbytes + index.known.numbers.nbytes == 12 * len(many)
    assert pickle.loads(pickle.dumps(index)).known.numbers_of(["name-7", "name-x"]) == [7, -1]


def test_words_of_many_texts_are_looked_up_together():
    rng = np.random.default_rng(5)
    letters = list("abc")
    words = ["".join(rng.choice(letters, rng.integers(1, 13))) + str(rng.choice(["", "!", "-"])) for _ in range(400)]
    names = sorted({name for word in words[:150] for name in toxicity.features_of(word)})
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(50)]
    plain = toxicity.Counts({name: i for i, name in enumerate(names)})
    asked = []

    class Known(toxicity.Names):
        def found(self, names):
            asked.append(names)
            return super().found(names)

    counts = toxicity.Counts(Known(names))
    for batch in (texts[:30], texts[20:], []):
        found = counts.of_texts(batch)
        assert [[part.tolist() for part in own] for own in found] == [[part.tolist() for part in plain(text)] for text in batch]
    # One search for whole words and one for beginnings of each length, not some for each text.
    assert len(asked) <= 2 * (2 + toxicity.LONGEST - toxicity.SHORTEST)


def test_a_loaded_index_holds_no_weight_for_each_posting():
    rng = np.random.default_rng(6)
    names = [f"w{i}" for i in range(3_000)]
    examples = [(" ".join(rng.choice(names, 200)), i % 2) for i in range(300)]
    df = collections.Counter(name for text, _ in examples for name in set(text.split()))
    index = toxicity.gather(examples, pd.DataFrame({"feature": names, "df": [max(1, df[n]) for n in names]}), {})
    large = [k for k, v in vars(index).items() if getattr(v, "nbytes", 0) >= 8 * len(index.codes) and k != "table"]
    assert large == [] and index.codes.nbytes + index.examples.nbytes <= 4 * len(index.codes)


def test_texts_of_a_large_batch_are_scored_part_by_part(spark):
    sizes = common.ROWS_AT_A_TIME * 2 + 5
    df = spark.range(0, sizes, 1, 1).selectExpr("id AS doc_id", "if(id % 7 = 0, null, string(id)) AS text")

    def compute():
        return lambda texts: [[len(text) for text in texts], [len(texts)] * len(texts)]

    found = common.append_columns(df, [("length", "long"), ("together", "long")], compute).collect()
    assert [r.doc_id for r in found] == list(range(sizes))
    assert all(r.length == len(r.text or "") and r.together <= common.ROWS_AT_A_TIME for r in found)
