"""The hash-tree manifest, removal of earlier word sequences and spelling groups against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rowferry.llm import merkle, spelling, substring_dedup

CLASH = "doc_id long, text string, lang string, source string, n_chars long, key long, `group` string, path string, leaf int, word string, n int, span int, doc string, _doc int, _lost int"


def frame(spark, rows, parts=3):
    """rows of (doc_id, source, text)."""
    data = [(i, t, "en" if (i or 0) % 3 else None, s, len(t) if t else None, 1, "g", "p", 2, "w", 3, 4, "d", 5, 6) for i, s, t in rows]
    return spark.createDataFrame(data, CLASH).repartition(parts)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- manifest


def tree(digests):
    """(root, siblings of every leaf as (before, after) by level)."""
    ways, level, mine = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for leaf, at in enumerate(mine):
            run = level[at - at % 3 : at - at % 3 + 3]
            ways[leaf].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
        mine = [at // 3 for at in mine]
    return level[0], ways


def manifest_of(rows):
    def leaf(r, text):
        parts = [r.doc_id, r.source, r.lang, r.n_chars, text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))

    groups = collections.defaultdict(list)
    for r in rows:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        text = r.text.replace("\n", "") if hit and r.text is not None else r.text
        groups["" if r.source is None else "+" + r.source].append(((r.doc_id is not None, r.doc_id or 0), leaf(r, r.text), leaf(r, text), r.doc_id))
    names = sorted(groups, key=str.encode)
    held = {g: tree([x[1] for x in sorted(groups[g])]) for g in names}
    root, ways = tree([held[g][0] for g in names])
    out = []
    for g, over in zip(names, ways):
        for (_, mine, shown, key), way in zip(sorted(groups[g]), held[g][1]):
            value = shown
            for before, after in way + over:
                value = sha(before + value + after)
            out.append((key, mine, held[g][0], root, sha("".join(a + b for a, b in way + over)), value, value == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    monkeypatch.setattr(merkle, "BROADCAST_GROUPS", 50_000 if levels == 6 else 2)
    rng = random.Random(1)
    texts = [None, "", "a\nb", "ünï\n\n漢", "x" * 5000 + "\n", "plain"]
    rows = [(k, "big", rng.choice(texts)) for k in range(40)]
    rows += [(100 + k, rng.choice([None, "", "b", "ß", "a+"]), rng.choice(texts)) for k in range(30)]
    rows += [(200, f"one{k}", "t\n") for k in range(5)] + [(None, "big", "x\n"), (None, None, None), (7, "big", "plain"), (7, "big", "plain")]
    docs = frame(spark, rows)
    found = merkle.report(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == manifest_of(docs.collect())


def test_manifest_of_one_large_group(spark):
    docs = frame(spark, [(k, "s", f"{k}\n") for k in range(800)])
    found = merkle.report(docs)
    assert sorted(map(tuple, found.collect()), key=repr) == manifest_of(docs.collect())


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.report(frame(spark, [(1, None, "a")])).collect()
    assert one[0].root == one[0].leaf == one[0].subroot == one[0].folded_root and one[0].proof_sha256 == sha("") and one[0].verified
    assert merkle.report(frame(spark, [])).count() == 0


def test_windows_hold_one_block(spark):
    docs = frame(spark, [(k, "s", "t") for k in range(10)])
    plan = merkle.climb_block(docs.selectExpr("source AS `group`", "doc_id AS place", "10L AS total", "text AS digest"))._jdf.queryExecution().toString()
    assert "hashpartitioning(group" in plan and "block" in plan and "Python" not in plan


# ---- removal of word sequences of earlier documents


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def without_earlier(rows, window=50):
    first = {}
    for key, text in rows:
        if key is not None:
            w = split(text)
            for k in range(len(w) - window + 1):
                at = tuple(w[k : k + window])
                first[at] = min(first.get(at, key), key)
    out = []
    for key, text in rows:
        w = split(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if key is not None and first[tuple(w[k : k + window])] < key:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((key, len(w), len(gone), sha(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(300)] + ["漢字", "É", "x"]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, " ".join(make(49))), (None, None)]
    passage, line = make(120), make(20)
    for k in range(30):
        length = rng.choice([49, 50, 51, 60, 70, 120])
        start = rng.randrange(120 - length + 1)
        rows.append((rng.randrange(100, 400), " ".join(make(rng.randrange(60))) + "\t" + "\n".join(passage[start : start + length]) + " " + " ".join(make(rng.randrange(60)))))
    # a line with many different neighbours, short repeats around it
    around = [make(35) for _ in range(4)]
    rows += [(500 + k, " ".join(make(rng.randrange(9)) + rng.choice(around) + line + rng.choice(around) + make(rng.randrange(9)))) for k in range(60)]
    rows += [(700 + k, " ".join(["again"] * (40 + 3 * k))) for k in range(8)]
    body = " ".join(make(200))
    rows += [(800, body), (800, body), (800, body + " more"), (801, body), (None, body), (900, " ".join([body] * 5)), (901, " ".join(make(20_000)) + " " + body)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("group", [2, 1000])
def test_earlier_sequences(spark, monkeypatch, repeats, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    docs = frame(spark, [(k, "s", t) for k, t in repeats], 5)
    found = substring_dedup.report(docs)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == without_earlier(repeats)


def test_removal_keeps_columns(spark, repeats):
    rows = [(k, "s", t) for k, t in repeats if k is None or k != 800]
    docs = frame(spark, rows)
    left = substring_dedup.remove(docs)
    assert left.schema == docs.schema
    wanted = {k: d for k, _, _, d in without_earlier([(k, t) for k, _, t in rows if k is not None])}
    ids = collections.Counter(k for k, _, _ in rows)
    for r in left.collect():
        if r.doc_id is not None and ids[r.doc_id] == 1:
            assert (sha(r.text) if r.text is not None else sha("")) == wanted[r.doc_id]
    assert left.filter("doc_id = 0 AND text IS NULL").count() == 1


def test_longer_keys_cover_all_windows():
    words = np.arange(200, dtype=np.uint64)
    for length in range(substring_dedup.SEED, substring_dedup.WINDOW):
        for size in range(1, substring_dedup.WINDOW - length + 2):
            for lead in range(size - 1, substring_dedup.WINDOW - length + 1):
                parts = list(substring_dedup.longer_keys(words, lead, size, length))
                assert [w for a, n, _, _ in parts for w in range(a, a + n)] == list(range(size))
                for start, count, at, longer in parts:
                    assert length < longer <= substring_dedup.WINDOW
                    # every window of the part holds its key
                    assert start + at >= start + count - 1 and at + longer <= substring_dedup.WINDOW


def test_no_rows_and_other_keys(spark):
    assert substring_dedup.report(frame(spark, [])).count() == 0
    with pytest.raises(TypeError):
        substring_dedup.report(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# ---- spellings


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_near_pairs_equal_edit_distance():
    rng = random.Random(3)
    for letters in ("ab", "abé", "abcdefgh"):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"a" * 300, "a" * 299})
        rng.shuffle(words)
        query, near = spelling.near_pairs(words)
        found = {(words[a], words[b]) for a, b in zip(query.tolist(), near.tolist())}
        assert len(found) == len(query)
        assert found == {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and distance(a, b) == 1}
    assert [len(x) for x in spelling.near_pairs([])] == [0, 0]


def spellings_of(rows):
    total = collections.Counter()
    for key, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [4, 20_000])
def test_spellings(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = random.Random(4)
    stems = ["separate", "definite", "éclairé", "Straße", "abcdef", "banana", "zzzzzzz", "recommendation"]
    rows = [(None, "Separate " * 7), (1, None), (2, ""), (3, "a × ÷ b"), (4, "z" * 3000 + " " + "z" * 2999)]
    for k in range(300):
        words = []
        for _ in range(30):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("eaé") + w[at:], w[:at] + rng.choice("eaé") + w[at + 1 :]])
            words.append(rng.choice([w, w.upper(), w]))
        rows.append((10 + k % 250, " ".join(words)))
    rows += [(5, "chainab " * 5), (6, "chainabc " * 25), (7, "chainabcd " * 125), (8, ("z" * 3000 + " " + "z" * 2999 + " ") * 5)]
    found = spelling.report(frame(spark, [(k, "s", t) for k, t in rows]))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows_found = sorted(map(tuple, found.collect()), key=repr)
    assert rows_found == spellings_of(rows)
    assert ("chainab", "chainabc", "chainabcd") in {r[:3] for r in rows_found}


def test_no_words(spark):
    assert spelling.report(frame(spark, [])).count() == 0
    assert spelling.report(frame(spark, [(1, "s", None), (2, "s", "short")])).count() == 0
