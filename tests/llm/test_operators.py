"""Small tables against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import public_tokenizers
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowferry.llm import bpe, chat, decontaminate, language, lm_score, ngram_join, quality, suffix_dedup, toxicity, url_filter
from rowferry.llm.url_filter import Rule

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
CLASH = "doc_id long, text string, lang string, n_words long, spans string, uid long, block int, runs_ string, comp long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def frame(spark, rows, langs=None):
    data = [(i, t, (langs or {}).get(i, "en"), 1, "x", 2, 3, "y", 4) for i, t in rows]
    return spark.createDataFrame(data, CLASH).repartition(3)


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies of several sizes, shared passages, odd texts."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = make(90)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "a b c d"), (6, "a b c d"), (7, "ünï cödé ße 漢字 x" * 80), (8, "z" * 3000)]
    for base in range(12):
        body = make(rng.choice([6, 9, 20, 60, 200, 700]))
        for copy in range(4):
            near = list(body)
            for _ in range(rng.randint(0, max(1, len(near) // 25))):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            rows.append((100 + base * 10 + copy, " ".join(near)))
    rows += [(300 + k, " ".join(make(40) + passage + make(rng.randint(5, 40)))) for k in range(45)]
    rows.append((500, " ".join(make(30_000))))
    return rows


def test_empty_tables(spark):
    docs, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int")
    for found in (
        bpe.round_trip(docs, PATH), ngram_join.join(docs), suffix_dedup.report(docs), lm_score.predict(docs), toxicity.predict(docs, labels),
        decontaminate.report(docs, spark.createDataFrame([], "item_id long, text string")), language.predict(docs), quality.judge(docs),
        chat.predict(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert found.count() == 0


def test_bpe_equals_the_library(spark, texts):
    rng = random.Random(1)
    odd = "aabB'st1٣Σσς İı<|endoftext|>\t\n ß漢🎉é!?-\x00\x1c\x85\xa0"
    rows = texts[:30] + [(1000 + k, "".join(rng.choices(odd, k=rng.randint(0, 30)))) for k in range(300)]
    rows += [(2000, "<|ENDOFTEXT|> <|startoftext|>'s"), (2000, "<|ENDOFTEXT|> <|startoftext|>'s"), (None, "null key")]
    library = Tokenizer.from_file(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.round_trip(frame(spark, rows), PATH).collect()), key=repr) == sorted(want, key=repr)
    coded = bpe.encode(frame(spark, rows), PATH)
    assert {(r.doc_id, len(r.ids)) for r in coded.collect()} == {w[:2] for w in want}
    read = {r.doc_id: r.text for r in bpe.decode(coded, PATH).collect()}
    assert all(sha(read[k]) == d for k, _, _, d in want)


def brute_components(rows):
    sets = {}
    for key, text in rows:
        w = words(text)
        sets[key] = set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(k, len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("group", [ngram_join.GROUP, 1])
def test_jaccard_join(spark, texts, monkeypatch, group):
    """Also where every shared part is passed over, so that the deeper ways have to find the links."""
    monkeypatch.setattr(ngram_join, "GROUP", group)
    if group == 1:
        monkeypatch.setattr(ngram_join, "OFTEN", 2)
    found = ngram_join.join(frame(spark, texts))
    assert {tuple(r) for r in found.collect()} == brute_components(texts)


def test_jaccard_join_of_one_passage(spark, monkeypatch):
    """Documents that are mostly one of two overlapping passages: only some sizes make a link."""
    monkeypatch.setattr(ngram_join, "GROUP", 1)
    monkeypatch.setattr(ngram_join, "OFTEN", 4)
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(90)]
    rows = []
    for k in range(60):
        body = passage[: 80 - 5 * (k % 3)] if k % 2 else passage[5:]
        rows.append((k, " ".join(body + [f"x{k}_{j}" for j in range(rng.randint(5, 40))])))
    found = {tuple(r) for r in ngram_join.join(frame(spark, rows)).collect()}
    assert found == brute_components(rows)
    assert 1 < len({c for _, _, c in found}) < 60


def test_jaccard_join_null_and_repeated_keys(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    assert sorted(map(tuple, ngram_join.join(frame(spark, rows)).collect()), key=repr) == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)], key=repr)
    assert sorted(r.doc_id for r in ngram_join.keep_one(frame(spark, rows[1:2] + rows[3:])).collect()) == [1]


def brute_removed(rows):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = collections.Counter(t[s : s + 400] for _, t in data for s in range(len(t) - 399))
    out = []
    for key, text in data:
        gone = bytearray(len(text))
        for s in range(len(text) - 399):
            if seen[text[s : s + 400]] > 1:
                gone[s : s + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(text, gone) if not g)
        out.append((key, len(text), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, texts):
    rows = [r for r in texts if r[0] != 500] + [(None, "q" * 399), (None, "q" * 399), (8, "z" * 3000), (9, "é" * 200), (9, "é" * 200)]
    found = sorted(map(tuple, suffix_dedup.report(frame(spark, rows)).collect()), key=repr)
    assert found == sorted(brute_removed(rows), key=repr)
    left = suffix_dedup.remove(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns and left.count() == len(rows)


def test_suffix_dedup_of_word_runs(spark):
    """Passages of 45 to 75 words, as the stage of the pipeline cuts them, against brute force."""
    import corpus_pipeline

    rng = random.Random(11)
    make = lambda n: [f"{rng.choice('aeiouäé')}{rng.randrange(100_000)}" for _ in range(n)]
    rows = [(0, None), (1, ""), (2, "same " * 49 + "same"), (3, "same " * 60)]
    for k, size in enumerate([45, 50, *range(51, 76, 4), 300]):
        passage = make(size)
        rows += [(10 + 3 * k + copy, " \n".join([" ".join(make(rng.randrange(30)) + passage), *make(rng.randrange(1, 30))])) for copy in range(3)]
    long = "x" * 450
    rows += [(100, f"{make(1)[0]} {long}"), (101, f"{long} {make(1)[0]}")]
    parts = {k: [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for k, t in rows}
    text = {k: (t or "").encode() for k, t in rows}
    window = lambda k, i: tuple(text[k][a:b] for a, b in parts[k][i : i + 51])
    by_words = collections.Counter(window(k, i) for k in text for i in range(len(parts[k]) - 50))
    by_bytes = collections.Counter(t[s : s + 400] for t in text.values() for s in range(len(t) - 399))
    want = {}
    for k, t in text.items():
        spans = [(s, s + 400) for s in range(len(t) - 399) if by_bytes[t[s : s + 400]] > 1]
        spans += [(parts[k][i][0], parts[k][i + 50][1]) for i in range(len(parts[k]) - 50) if by_words[window(k, i)] > 1]
        gone = {at for a, b in spans for at in range(a, b)}
        want[k] = bytes(c for at, c in enumerate(t) if at not in gone).decode("utf-8", "ignore")
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    left = {r.doc_id: r for r in corpus_pipeline.without_repeats(spark, docs, "").collect()}
    assert {k: r.text or "" for k, r in left.items()} == want
    assert all(len(want[10 + 3 * k].split()) < 60 for k in range(2, 10)) and left[10].text == dict(rows)[10]


def test_suffix_query_reports_passages(spark, tmp_path):
    """Passages of over 50 words that are shorter than 400 bytes, beside the removal by bytes alone, against brute force."""
    from rowferry.llm import queries

    rng = random.Random(13)
    make = lambda n: [f"{rng.choice('aeiouäé')}{rng.randrange(1000)}" for _ in range(n)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "same " * 50), (4, "one " * 55), (None, "z" * 900)]
    for k, size in enumerate([49, 50, 51, 55, 70, 200]):
        passage, other = make(size), make(52)
        rows += [(10 + 3 * k + copy, " \n".join([*make(rng.randrange(30)), " ".join(passage), *make(rng.randrange(1, 30)), *other[: 52 * (copy > 0)]])) for copy in range(3)]
    parts = [[m[0] for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    seen = collections.Counter(tuple(p[i : i + 51]) for p in parts for i in range(len(p) - 50))
    want = []
    for row, p in zip(brute_removed(rows), parts):
        inside = bytearray(len(p))
        for i in range(len(p) - 50):
            if seen[tuple(p[i : i + 51])] > 1:
                inside[i : i + 51] = b"\1" * 51
        want.append((*row, len(p), sum(inside), len([x for x in bytes(inside).split(b"\0") if x])))
    assert any(r[2] == 0 < r[6] for r in want) and any(r[7] > 1 for r in want) and any(r[2] > 0 == r[6] for r in want)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op3_suffix_dedup"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_words", "n_passage_words", "n_passages"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 700])
def test_suffix_blocks(monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    data = np.frombuffer(random.Random(2).randbytes(5000), np.uint8)
    gram, _, first, last, lead = suffix_dedup.runs_of(data)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert covered.tolist() == list(range(5000 - 399)) and (lead >= 0).all() and len(gram)


def test_lm_score(spark, texts):
    rows = texts + [(None, "null key")]
    count, total = collections.Counter(), 0
    chains = [(k, words(t) + [None]) for k, t in rows]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0
    for key, chain in chains:
        if not held(key):
            count.update(chain)
    total = sum(count.values())
    want = {k: (held(k), len(c), sum(count[w] > 0 for w in c), total, sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in c)) for k, c in chains}
    found = lm_score.predict(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4]) and r.score <= 0
    seen = [r for r in found if not r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_lm_waves_give_the_same(spark, texts):
    docs = frame(spark, texts[:40])
    one = sorted((r.doc_id, round(r.score, 6)) for r in lm_score.score(docs).collect())
    many = sorted((r.doc_id, round(r.score, 6)) for r in lm_score.score(docs, wave_bytes=500).collect())
    assert one == many


def brute_scores(train, rows):
    """The formula of the model with quantised counts of all bigrams."""
    level = lambda c: float(lm_score.restored(lm_score.quantise(np.array([c])))[0])
    chain = lambda t: list(itertools.pairwise(["<", *words(t), ">"]))
    pairs = collections.Counter(p for t in train for p in chain(t))
    counts, types, uni = collections.Counter(), collections.Counter(h for h, _ in pairs), collections.Counter()
    for (h, w), c in pairs.items():
        counts[h] += c
        uni[w] += c
    total, out = sum(uni.values()), {}
    for k, text in rows:
        out[k] = 0.0
        for h, w in chain(text):
            share = (uni[w] + 0.1) / (total + 0.1 * (len(uni) + 1))
            kinds = min(level(types[h]), counts[h]) if types[h] else 0
            seen = level(pairs[h, w]) if pairs[h, w] else 0.0
            out[k] += math.log10(min(1.0, (seen + kinds * share) / (counts[h] + kinds)) if counts[h] else share)
    return out


def test_lm_counts_every_bigram(spark, texts):
    """A bigram met once scores higher than an unseen one, as in the formula."""
    rows = [r for r in texts[:60] if r[0] != 8] + [(900, "solo " + " ".join(f"once{k} seen{k}" for k in range(40)))]
    want = brute_scores([t for _, t in rows], rows)
    found = {r.doc_id: r.score for r in lm_score.score(frame(spark, rows)).collect()}
    # the filter may take a few unseen pairs or levels for met ones
    close = [abs(found[k] - want[k]) <= 0.02 * abs(want[k]) + 1e-6 for k in want]
    assert sum(close) > 0.9 * len(close)
    assert found[900] == pytest.approx(want[900], rel=0.05)


def test_lm_scores_histories_of_empty_parts(spark):
    """Few training words and many parts: what follows an unseen word has its share, in any number of waves."""
    rows = [(0, "a b c"), (1, "a b"), (2, " ".join(f"new{k}" for k in range(50))), (3, "a new1 b")]
    docs, want = frame(spark, rows), brute_scores(["a b c", "a b"], rows)
    for size in (lm_score.WAVE_BYTES, 20):
        found = {r.doc_id: r.score for r in lm_score.score(docs, docs["doc_id"] < 2, wave_bytes=size).collect()}
        assert all(found[k] == pytest.approx(want[k], rel=0.02) for k in want), (size, found, want)


def test_filter_gives_counts_back():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64)
    counts = np.arange(1, 2001)
    slices = lm_score.Slices({0: lm_score.build_slice(keys, lm_score.quantise(counts)).tobytes()}, 1)
    got = slices.levels(keys, keys)
    assert (got >= lm_score.quantise(counts)).all() and (got == lm_score.quantise(counts)).mean() > 0.97
    assert (slices.levels(keys + np.uint64(1), keys + np.uint64(1)) > 0).mean() < 0.03


def spoken(found):
    """conversation -> (state of each line, text of each turn), from rows of turns."""
    out = {}
    for r in sorted(found, key=lambda r: (repr(r.conv), r.line)):
        states, turns = out.setdefault(r.conv, ([], []))
        assert r.line == len(states)
        state = 2 * chat.ROLES.index(r.role)
        states += [state + (not r.opens), *[state + 1] * (r.n_lines - 1)]
        turns.append(r.rendered) if r.opens else turns.append(turns.pop() + r.rendered)
    return out


def path_score(path, codes, model):
    total = model["first"][path[0]] + model["emit"][path[0]][codes[0]]
    for before, state, c in zip(path, path[1:], codes[1:]):
        total += model["move"][before][state] + model["emit"][state][c]
    return total


def brute_path(codes, model):
    """The best of all state sequences, and whether it is the only one."""
    import itertools

    ranked = sorted(((path_score(p, codes, model), p) for p in itertools.product(range(chat.STATES), repeat=len(codes))), reverse=True)[:2]
    return list(ranked[0][1]), ranked[0][0] - ranked[1][0] > 1e-9


def model_of(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], (f"User: how?{c}\nplease", "AI: yes\n- one\n- two")[t % 2] if (c + t) % 5 else ("why?", "Well then")[t % 2]) for c in range(20) for t in range(6)]
    said = spark.createDataFrame(rows + [(50, 0, "system", "System: be kind")], "conv long, turn long, role string, text string")
    return chat.learn(chat.lines_of(said, ("turn",), ("role",)))


def test_chat_equals_all_paths(spark):
    rng, model = random.Random(5), model_of(spark)
    lines = ["User: hi?", "ai: yes", "[Bot]: - no", "well then", "- one", "", "### System: be kind", "why?", "Q : \t1"]
    texts = {c: "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 5))) for c in range(25)}
    frame_ = spark.createDataFrame(list(texts.items()), "conv long, text string")
    coded = {}
    for r in chat.lines_of(frame_).orderBy("place").collect():
        coded.setdefault(r.conv, []).append(r.code)
    for size in (1024, 3, 1):
        got = spoken(chat.format_turns(chat.lines_of(frame_, chunk=size), model, size).collect())
        assert set(got) == set(texts)
        for conv, codes in coded.items():
            want, single = brute_path(codes, model)
            assert not single or got[conv][0] == want, (size, texts[conv])


def test_chat_chunks_are_exact(spark, monkeypatch):
    rng, model = random.Random(6), model_of(spark)
    lines = ["User: hi?", "AI: yes", "well then", "System: be kind", "- a", "how?"]
    texts = [(k, "\n".join(rng.choice(lines) for _ in range(n))) for k, n in enumerate((400, 1, 7, 150))] + [(None, "x\r\ny"), (9, None)]
    raw = spark.createDataFrame(texts, "conv long, text string")
    whole = spoken(chat.format_turns(chat.lines_of(raw), model).collect())
    assert {k: len(v[0]) for k, v in whole.items()} == {0: 400, 1: 1, 2: 7, 3: 150, None: 2, 9: 1}
    coded = {}
    for r in chat.lines_of(raw).orderBy("place").collect():
        coded.setdefault(r.conv, []).append(r.code)
    monkeypatch.setattr(chat, "FAN", 4)
    for size in (7, 64):
        cut = spoken(chat.format_turns(chat.lines_of(raw, chunk=size), model, size).collect())
        assert cut.keys() == whole.keys()
        for conv, codes in coded.items():
            # paths of equal score may differ
            assert path_score(cut[conv][0], codes, model) == pytest.approx(path_score(whole[conv][0], codes, model), abs=1e-7), (size, conv)
            assert sum(t.count("\n") - 3 for t in cut[conv][1]) == len(codes) - len(cut[conv][1])


def test_chat_recovers_marked_turns(spark):
    rng = random.Random(7)
    names = {"system": "System", "user": "Human", "assistant": "Assistant"}
    turns = {c: [(("user", "assistant")[t % 2], "\n".join(rng.choice(["How so?", "- this", "Well now", "and more", ""]) for _ in range(rng.randint(1, 4)))) for t in range(8)] for c in range(60)}
    rows = [(c, t, r, f"{names[r]}: {text}") for c, said in turns.items() for t, (r, text) in enumerate(said) if c >= 30]
    model = chat.learn(chat.lines_of(spark.createDataFrame(rows, "conv long, turn long, role string, text string"), ("turn",), ("role",)))
    raw = spark.createDataFrame([(c, "\n".join(f"{names[r]}: {t}" for r, t in said), "x") for c, said in turns.items() if c < 30], "conv_id long, text string, line string")
    got = spoken(chat.format_transcripts(raw, model).collect())
    assert {c: v[1] for c, v in got.items()} == {c: [f"<|{r}|>\n{t}\n<|end|>\n" for r, t in said] for c, said in turns.items() if c < 30}


def test_chat(spark):
    turns = [(c, t, ("user", "assistant")[t % 2], ("How is {} {}?", "It is {}\nand {}")[t % 2].format(c, t)) for c in range(60) for t in range(6)]
    rows = turns + [(None, 0, "user", "x"), (None, None, "user", "x"), (7, None, "user", None), (8, 1, "assistant", "again"), (8, 1, "assistant", "again"), (9, 0, "tool", "odd role"), (70, 0, "user", "y " * 200_000)]
    talks = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, place long, chunk long")
    found = chat.predict(talks)
    assert found.columns == ["conv_id", "line", "n_lines", "opens", "held_out", "role", "rendered"]
    got = spoken([type("Row", (), {**r.asDict(), "conv": r.conv_id}) for r in found.collect()])
    assert sum(len(v[0]) for v in got.values()) == sum((t or "").count("\n") + 1 for *_, t in rows)
    right = [got[c][0] == [0 + 2, 4, 5] * 3 for c in range(60) if c not in (7, 8, 9)]
    assert sum(right) > 0.9 * len(right)


def test_url_filter(spark):
    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "com", "/de/")]
    urls = [None, "", "nothing", "http://A.Example.ORG/es/1?x", "http://example.org", "https://www.bad.net/p/1.html#t", "http://bad.net/p/1/", "http://bad.net/p/2", "http://bad.net/p/1", "x://y.com/de/z://q", "http://notcom/de/"]
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)], "page_id long, url string, host string, path string")
    listed = spark.createDataFrame([("bad.net/p/1",), ("bad.net/p/1",), (None,), ("",)], "url string")
    for blocks in (url_filter.BLOCKS, 1):
        found = {r.page_id: r for r in url_filter.judge(pages, listed, rules, blocks=blocks).collect()}
        assert [found[k].verdict for k in range(len(urls))] == ["allow", "allow", "allow", "block", "allow", "block", "block", "allow", "block", "block", "allow"]
        assert (found[3].host, found[3].path, found[3].rule) == ("a.example.org", "/es/1", "example.org/es/")
        assert found[4].rule is None and found[9].rule == "com/de/" and (found[0].host, found[0].path) == ("", "")


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [(0, None), (1, ""), (2, "漢字")], [(0, 0), (None, 1), (1, None)]
    for k in range(3, 603):
        body, bad = [rng.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(60)], k % 5 == 0
        if bad:
            body[rng.randrange(60)] = rng.choice(["vile", "Foul!"])
        rows.append((k, " ".join(body)))
        labels += [(k, int(bad)), (k, int(bad))]
    found = {r.doc_id: r for r in toxicity.predict(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(found) == len(rows) and found[0].predicted == found[1].predicted == 0
    tested = [(found[k].predicted, int(k % 5 == 0)) for k in range(3, 603) if found[k].held_out]
    assert sum(a == b for a, b in tested) > 0.98 * len(tested)
    text = dict(rows)[5]
    span = found[5].spans[0]
    assert text.encode()[span.start : span.end].decode().lower() in ("vile", "foul")


def test_decontaminate(spark, texts):
    items = [(10, "w1 W2, w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "Short one!"), (2, "Short one!"), (3, None), (4, "..."), (None, "lonely")]
    rows = texts[:25] + [(900, "x " + items[0][1] + " y short-ONE z"), (901, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (902, "lonely"), (903, "shortone"), (None, "é short one")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.GROUP_BYTES, 20):
        found = {r.doc_id: r for r in decontaminate.report(frame(spark, rows), tests, group_bytes=size).collect()}
        assert (found[900].n_words, found[900].n_hit, found[900].n_items) == (16, 13, 2)
        assert found[900].items_sha256 == hashlib.sha256(b"10,2").hexdigest()
        assert (found[901].n_hit, found[903].n_hit, found[902].n_hit, found[0].n_words, found[None].n_hit) == (0, 0, 1, 0, 2)
    kept = {r.doc_id for r in decontaminate.drop_leaks(frame(spark, rows), tests).collect()}
    assert not kept & {900, 902, None} and {0, 1, 901, 903} <= kept


def test_decontaminate_groups_do_not_merge_rows(spark):
    """Repeated rows, null keys and two texts of one key have a result each, in any number of groups."""
    items = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k}") for k in range(6)], "item_id long, text string")
    hit = lambda k: f"x alpha{k} beta{k} gamma{k} alpha{k + 1} beta{k + 1} gamma{k + 1} y"
    rows = [(1, hit(0)), (1, hit(0)), (1, "clean words here"), (None, hit(2)), (None, "other"), (None, None), (2, hit(3)), (2, hit(0))]
    docs = frame(spark, rows)
    one, many = (sorted((tuple(r) for r in decontaminate.find_leaks(docs, items, group_bytes=size).collect()), key=repr) for size in (decontaminate.GROUP_BYTES, 40))
    assert one == many and len(many) == len(rows)
    assert [tuple(map(int, r[2][0])) for r in many if r[2]] == [(1, 6, 2, 41)] * 5
    assert sorted(map(tuple, (r[3] for r in many if r[3]))) == [("0", "1")] * 3 + [("2", "3"), ("3", "4")]
    hits = sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in decontaminate.report(docs, items, group_bytes=40).collect())
    assert hits == [(0, 0, 0), (0, 1, 0), (0, 8, 6), (1, 3, 0), (1, 8, 6), (1, 8, 6), (2, 8, 6), (2, 8, 6)]


def test_decontaminate_offsets(spark):
    text = "  Ünder — the Quick, brown fox"
    rows = decontaminate.find_leaks(frame(spark, [(1, text)]), spark.createDataFrame([(1, "QUICK brown")], "item_id long, text string")).collect()
    span = rows[0].spans[0]
    assert text.encode()[span.start : span.end].decode() == "Quick, brown"


def test_language(spark):
    rng = random.Random(4)
    pools = {"en": "the and that with from this have".split(), "de": "der und die nicht mit sich auch".split(), "fr": "les des une est pour dans que".split()}
    rows, langs = [(0, None), (1, ""), (2, "12 !?")], {0: "en", 1: None}
    for k in range(3, 203):
        lang = sorted(pools)[k % 3]
        rows.append((k, " ".join(rng.choice(pools[lang]) for _ in range(30))))
        langs[k] = lang if k % 7 else None
    rows.append((500, " ".join(rng.choice(pools["de"]) for _ in range(300_000))))
    langs[500] = None
    found = {r.doc_id: r for r in language.predict(frame(spark, rows, langs)).collect()}
    assert [found[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and found[500].lang_pred == "de"
    assert all(found[k].lang_pred == sorted(pools)[k % 3] and 0 <= found[k].score <= 1 for k in range(3, 203))


def test_grams_do_not_depend_on_blocks(monkeypatch):
    text = "Ab cd, é fgh-" * 50
    keys, counts = language.grams(text)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(language, "BLOCK", size)
        again, sums = language.grams(text)
        assert again.tolist() == keys.tolist() and sums.tolist() == counts.tolist()


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {k + d for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality(spark, texts):
    body = "\n".join(" ".join(f"word{k}{j}" for j in range(12)) for k in range(6))
    rows = texts + [(900, body), (901, body + "\nHome | About | News | Contact\nAll Rights Reserved"), (902, "\n".join("a%d | b | c | d" % k for k in range(40))), (903, "x y z " * 40), (904, "l\nl\n\n \nl"), (904, "l\nl\n\n \nl")]
    found = quality.judge(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text[r.doc_id]), r.doc_id
    by = {r.doc_id: r for r in found}
    assert by[900].kept and by[901].kept and by[901].cleaned == body and not by[902].kept and not by[903].kept
    plan = quality.judge(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("Exchange RoundRobin")[0]


def brute_clean(text):
    """The text without failing lines, by a plain loop."""
    lines = text.split("\n")

    def short(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        return len(x) <= 40 and 1 <= len(w) <= 3 and w[0][0] not in "0123456789*•-" and w[-1][-1] not in ".!?:;,…。！？、，：；\"'”’»)]" and not re.search(r"[\x0b\x0c]", x)

    def fails(x):
        symbols = sum(c in "#*$%&|<>" for c in x)
        bars = len(re.findall(r"[|•·»›]| [/>] ", x))
        teaser = len(x) <= 100 and re.sub(r"[\])]$", "", x.rstrip(" \t\r")).endswith(("...", "…"))
        return symbols > 0.3 * len(x) or bars >= 3 or any(p in x.lower() for p in quality.BOILERPLATE) or teaser or (x.strip(" \t\n\x0b\x0c\r") != "" and not any(c.isalnum() for c in x))

    flags = [short(x) for x in lines]
    menu = [any(all(0 <= j < len(flags) and flags[j] for j in range(k - d, k - d + 4)) for d in range(4)) for k in range(len(lines))]
    return "\n".join(x for x, m in zip(lines, menu) if not m and not fails(x))


def test_quality_lines(spark):
    """Menus without bars go, verse and lists stay; the rest as a plain loop has it."""
    body = "\n".join(" ".join(f"word{k}{j}" for j in range(12)) + "." for k in range(6))
    verse = "\n".join(f"the {w} sings of morning," for w in ("lark", "thrush", "wren", "crow"))
    listed = "\n".join(f"- item {k}" for k in range(6)) + "\n1 one\n2 two\n3 three\n4 four"
    menu = "Home\nAbout us\nContact\n Our News\nShop"
    odd = [
        "Home\nAbout\nNews\nbye.", "Home\r\nAbout\r\nNews\r\nShop\r\n", "a\nb\n\nc\nd", "-----\n* * *\ntext …\nmore (...)\n", "one / two / three / four", "a • b • c • d\n• x\n• y", "", "\n\n\n\n\n",
        "a\u2028\nb\nc\nd", "w" * 50 + "\nb\nc\nd", "x...\u0085", "日本\n語。\nab\ncd\nef", "\n".join("menu%s" % c for c in "abcdefgh") + "\nThe end.",
    ]
    rng = random.Random(11)
    odd += ["\n".join(rng.choice(["Home", "Top news", "- x", "Yes.", "", "a b c d", "see more...", "##", "7 up", "ok"]) for _ in range(12)) for _ in range(60)]
    rows = [(1, body + "\n" + menu), (2, verse + "\n" + listed), (3, "\n".join(f"word{k} more{k}" for k in range(60)))] + [(10 + k, t) for k, t in enumerate(odd)] + [(None, menu), (None, menu)]
    found = quality.judge(frame(spark, rows)).collect()
    by = {r.doc_id: r for r in found}
    assert by[1].cleaned == body and by[1].kept and by[2].cleaned == verse + "\n" + listed and not by[3].kept and not by[3].base_failed
    assert sum(r.doc_id is None and r.cleaned == "" for r in found) == 2
    for key, text in rows:
        assert by[key].cleaned == brute_clean(text), repr(text)


def brute_language(rows, size):
    """Prediction of every text by plain counting: {doc_id: (language, score)}."""
    import zlib

    def ranked(*texts):
        counts = collections.Counter()
        for text in texts:
            codes = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
            counts.update(c for c in codes if c)
            counts.update(a | b << 21 | 1 << 62 for a, b in zip(codes, codes[1:]) if a or b)
            counts.update(a | b << 21 | c << 42 for a, b, c in zip(codes, codes[1:], codes[2:]) if b)
        return sorted(counts, key=lambda k: (-counts[k], k))[:size]

    said = {}
    for key, text, lang in rows:
        if text is not None and lang is not None and (key is None or zlib.crc32(str(key).encode()) % 5 != 0):
            said.setdefault(lang, []).append(text)
    places = {lang: {k: n for n, k in enumerate(ranked(*texts))} for lang, texts in said.items()}
    out = {}
    for key, text, _ in rows:
        mine = ranked(text or "")
        if not any(c.isalpha() for c in (text or "").lower()):
            out[key] = ("und", 0.0)
            continue
        near = {lang: 1 - sum(abs(p[k] - n) if k in p else size for n, k in enumerate(mine)) / (size * len(mine)) for lang, p in places.items()}
        best = min(sorted(near), key=lambda lang: -near[lang])
        out[key] = (best, near[best] / sum(near.values()) if sum(near.values()) > 0 else 1 / len(near))
    return out


def test_language_equals_plain_counting(spark):
    rng = random.Random(21)
    parts = {"aa": "la ma ri to su", "bb": "krz chy szt ów ż", "cc": "the and ing ou wh"}
    rows = [(k, "".join(rng.choice(parts[lang].split()) + rng.choice(["", " ", ". ", "\n"]) for _ in range(rng.randint(1, 60))), lang) for k, lang in enumerate(rng.choices(list(parts), k=60))]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 -- 3", "cc"), (103, "la the krz", None), (None, "the and", "cc"), (105, "z" * 5000, "aa"), (105, "z" * 5000, "aa"), (106, "İSTANBUL ß漢字", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    want = brute_language(rows, language.PROFILE)
    found = language.predict(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-9), r


def small_tagger():
    factors = np.array([30.0, 4.0, 0.2, 0.6])
    return toxicity.Tagger(np.array([10, 20, 30]), factors, np.array([0.9, 0.1, 0.35, 0.65]), np.zeros(4))


def test_marginals_equal_all_taggings():
    """Every tagging of short texts, weighed and summed; the tag before a text is clean."""
    rng, model = random.Random(31), small_tagger()
    texts = [[rng.choice([0, 1, 2, 3, 3, 3]) for _ in range(rng.randint(1, 9))] for _ in range(60)] + [[], [3, 3], [0], [0] * 8, [0] * 8]
    ids, bounds = np.array([w for t in texts for w in t]), np.cumsum([0, *map(len, texts)])
    places, found = toxicity.marginals(model, ids, bounds)
    got = dict(zip(places.tolist(), found.tolist()))
    assert len(got) == len(places)
    for text, first in zip(texts, bounds):
        if not any(w < 3 for w in text):
            assert not any(first + k in got for k in range(len(text)))
            continue
        total, toxic = 0.0, [0.0] * len(text)
        for tags in itertools.product((0, 1), repeat=len(text)):
            weight = math.prod(model.moves[2 * a + b] for a, b in zip((0, *tags), tags)) * math.prod(model.factors[w] for w, t in zip(text, tags) if t)
            total += weight
            toxic = [x + weight * t for x, t in zip(toxic, tags)]
        assert [got[first + k] for k in range(len(text))] == pytest.approx([x / total for x in toxic], abs=1e-12), text


def test_marginals_of_long_texts():
    """A text far longer than a word's reach, against sums over the whole of it."""
    model, size = small_tagger(), 700
    ids = np.full(size, 3)
    ids[[200, 203, 230, 500]] = [0, 1, 0, 2]
    places, found = toxicity.marginals(model, ids, np.array([0, size]))
    move = model.moves.reshape(2, 2)
    local = [np.array([1.0, model.factors[w]]) for w in ids]
    ahead, behind = [move[0] * local[0]], [np.ones(2)]
    for k in range(1, size):
        step = ahead[-1] @ move * local[k]
        ahead.append(step / step.sum())
        back = move @ (local[size - k] * behind[-1])
        behind.append(back / back.sum())
    both = np.array(ahead) * np.array(behind[::-1])
    assert {200, 203, 230, 500} <= set(places.tolist())
    assert found == pytest.approx((both[:, 1] / both.sum(1))[places], abs=1e-6)


def test_fit_counts_equal_windows():
    """Packed windows come back; a window with a number stands for so many; the fit holds a block at a time."""
    rng, span = np.random.default_rng(7), 2 * toxicity.WINDOW + 1
    ids = np.where(rng.random((300, span)) < 0.2, rng.integers(0, 900, (300, span)), 900)
    tags = (ids < 900) & (rng.random((300, 1)) < 0.4)
    back = toxicity.unpacked(toxicity.packed(ids, tags).to_pylist())
    assert (back[0] == ids).all() and (back[1] == tags).all()
    number = rng.integers(1, 4, 300)
    again = toxicity.fit_field(np.repeat(ids, number, 0), np.repeat(tags, number, 0), 900, rounds=20)
    assert all(a == pytest.approx(b, rel=1e-9) for a, b in zip(toxicity.fit_field(*back, 900, number, rounds=20), again))
    many = np.tile(back[0], (200, 1)), np.tile(back[1], (200, 1))
    tracemalloc.start()
    toxicity.fit_field(*many, 900, rounds=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20


def test_toxicity_bound_is_on_different_windows(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("lorem ipsum dolor sit amet elit".split()) for _ in range(30)) for _ in range(8)]
    rows = [(k, texts[k % 8] + (" vile" if k % 4 == 0 else "")) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    bound, free = (toxicity.train(frame(spark, rows), labels, max_windows=n) for n in (20, 100_000))
    assert len(bound.words) == 1 and bound.factors == pytest.approx(free.factors) and bound.moves == pytest.approx(free.moves)


def test_common_sets_in_tiles(spark, monkeypatch):
    """Sets of common shingles in small tiles link as all pairs do, and a star stands for the links of a tile."""
    monkeypatch.setattr(ngram_join, "TILE", 6)
    rng, base = random.Random(17), [k * 7919 for k in range(1, 61)]
    rows = [(k, 40 + rng.randint(0, 4), sorted(rng.sample(base[:44], 40))) for k in range(50)] + [(60 + k, 41 + 3 * k, base[:40]) for k in range(5)]
    common = spark.createDataFrame(rows, "doc long, n long, common array<long>")
    comps = spark.createDataFrame([(60, 60), (61, 60), (3, 3), (4, 3)], "doc long, comp long")
    links = ngram_join._by_common(ngram_join.Workspace(spark), common, comps)  # noqa: SLF001

    def classes(edges):
        above = {}

        def top(x):
            while above.setdefault(x, x) != x:
                x = above[x]
            return x

        for a, b in edges:
            above[top(a)] = top(b)
        return {frozenset(k for k, *_ in rows if top(k) == t) for t in {top(k) for k, *_ in rows}}

    given = [(61, 60), (4, 3)]
    alike = [(a, b) for a, n, x in rows for b, m, y in rows if a < b and 100 * len({*x} & {*y}) >= 75 * (n + m - len({*x} & {*y}))]
    found = [tuple(r) for r in links.select("a", "b").collect()]
    assert classes(given + found) == classes(given + alike) and 1 < len(classes(given + alike)) < 50
    n = 40
    table = pa.table({"h": range(n), "doc": range(n), "n": [50] * n, "lo": range(n), "hi": range(n), "common": [base[:50]] * n})
    assert sorted(ngram_join.alike_sets(table).select(["a", "b"]).to_pydict()["a"]) == list(range(1, n))


def test_wanted_texts_only(spark):
    """Every wanted text comes, no other one, and few others enter the shuffle."""
    data = spark.range(3000).selectExpr("cast(id as int) * 37 - 50000 AS doc", "string(id) AS text")
    pairs = data.filter("doc % 5 = 0").selectExpr("doc AS a", "doc + 37 * 20 AS b")
    want = {r.a for r in pairs.collect()} | {r.b for r in pairs.collect()}
    got = ngram_join._texts(data, pairs)  # noqa: SLF001
    assert sorted(r.doc for r in got.collect()) == sorted(want & {r.doc for r in data.collect()})
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Join " in line or "Join " in line[:12]]  # noqa: SLF001
    assert len(joins) == 2 and "bucket" not in joins[0] and "bucket" in joins[1]


def test_rows_that_may_be_among_ids(spark):
    """All rows are in one of the two parts, those of the ids in the first, with few others; null keys and clashing names too."""
    from rowferry.llm.shared import maybe_among

    data = spark.range(3000).selectExpr("nullif(id % 1500, 7) AS doc", "string(id) AS _marks")
    ids = spark.range(0, 1500, 3).selectExpr("id AS k").union(spark.range(5000, 5100).toDF("k"))
    some, rest = (x.collect() for x in maybe_among(data, F.col("doc"), ids))
    assert sorted([*some, *rest], key=repr) == sorted(data.collect(), key=repr)
    wanted = {r.k for r in ids.collect()}
    assert not wanted & {r.doc for r in rest} and sum(r.doc not in wanted for r in some) < 10
    none, all_ = maybe_among(data, F.col("doc"), ids.limit(0))
    assert none.count() == 0 and all_.count() == 3000


def _joins(df):
    """The joins of the optimised plan of a result that has been taken."""
    df.collect()
    plan = df._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    return [line for line in plan.splitlines() if re.search(r"\bJoin ", line)]


def test_one_of_each_group_shuffles_few_texts(spark, texts):
    """One document of each component is left, null keys stay, and the texts pass a bitmap before the join."""
    rows = [*texts[:30], (None, "a b c d e f"), (None, None)]
    docs = frame(spark, rows)
    left = ngram_join.keep_one(docs)
    comps = {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()}
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None) == sorted((k, t) for k, t in rows if k is not None and comps[k] == k)
    assert sum(r.doc_id is None for r in left.collect()) == 2 and left.columns == docs.columns
    joins = _joins(left)
    assert not any("LeftAnti" in j for j in joins) and sum("bucket" in j for j in joins) == 2


def test_suffix_dedup_shuffles_few_texts(spark):
    """Texts without repeats go by the last join, and nothing but the runs is left of what was written for it."""
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdef ") for _ in range(700))
    rows = [(k, "".join(rng.choice("abcdef ") for _ in range(900)) + (shared if k % 40 == 0 else "")) for k in range(400)]
    left = suffix_dedup.report(frame(spark, rows))
    assert sorted(map(tuple, left.collect())) == sorted(brute_removed(rows))
    assert sum("bucket" in j for j in _joins(left)) == 2
    assert not [f for f in left.inputFiles() if "/anchors-" in f]


def test_stages_bound_their_batches(spark):
    """Long texts come in batches of a few MB once a stage has begun, and a task leaves no free memory of Arrow behind."""
    import corpus_pipeline
    from rowferry.llm.flat import tidy
    from rowferry.session import BATCH_BYTES

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 20000) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    sizes = lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        assert max(r.n for r in docs.mapInArrow(tidy(sizes), "n long").collect()) > 20 << 20
        corpus_pipeline.encoded(spark, docs, "")
        assert BATCH_BYTES == "4m" and max(r.n for r in docs.mapInArrow(tidy(sizes), "n long").collect()) < 5 << 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_pipeline_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, "/root/testdata/sf0.001")
        assert left.columns == docs.columns and left.count() <= docs.count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_combined_anchors():
    """One counted row for each anchor and stretch; the other rows of it are dealt out with n = 0."""
    gram, span = np.array([5, 5, 7, 5, 7]), np.array([1, 1, 2, 9, 2])
    first, owner = np.array([30, 10, 0, 4, 6]), np.array([3, 2, 1, 1, 1])
    out = suffix_dedup.combined((gram, span, first, first + 1, first), owner)
    counted = {(int(g), int(s)): (int(u), int(f), int(n)) for g, s, u, f, n in zip(out["gram"], out["span"], out["uid"], out["first"], out["n"]) if n}
    assert counted == {(5, 1): (2, 10, 2), (5, 9): (1, 4, 1), (7, 2): (1, 0, 2)}
    rest = sorted((int(u), int(f)) for u, f, n in zip(out["uid"], out["first"], out["n"]) if not n)
    assert rest == [(1, 6), (3, 30)]
    assert not {5, 7} & {int(g) for g, n in zip(out["gram"], out["n"]) if not n}
