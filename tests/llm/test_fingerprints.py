import hashlib

import numpy as np
import xxhash

from granary.llm import fingerprints as fp
from granary.llm.textops import span_hashes


def phrases(text):
    """The phrase set of an LZ78 parse of the bytes, by strings; (phrase, 1) is an unfinished one."""
    data, seen, start = text.encode(), set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return {(p, 0) for p in seen} | ({(data[start:], 1)} if start < len(data) else set())


def plain_print(text):
    """The smallest hashes of the phrases, each hashed by itself."""
    zero, hashes = np.zeros(1, np.int64), set()
    for phrase, seed in phrases(text or ""):
        hashes.add(int(span_hashes(np.frombuffer(phrase, np.uint8), zero, zero + len(phrase), seed=seed)[0]) >> 32)
    return sorted(hashes)[:64]


def text_mark(text):
    """xxhash64 as Spark computes it, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).astype(np.int64))


def shown(hashes):
    return "".join(f"{h:08x}" for h in hashes)


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    least = sorted({*a, *b})[:64]
    return sum(h in a and h in b for h in least) / len(least)


def brute(docs):
    """Rows as the query must give them, from phrase sets."""
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, text_mark(d[1])))
    out = []
    for k, (i, t) in enumerate(docs):
        t, n = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        own, new, following = plain_print(t), plain_print(edited), plain_print(n)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(new), plain_likeness(own, new), plain_likeness(own, following)))
    return sorted(out, key=repr)


def test_the_end_of_a_text_counts():
    for a, b in (("a", "aa"), ("ab", "aba"), ("abc", "abca"), ("aab", "aaba")):
        assert fp.fingerprint(a).tolist() != fp.fingerprint(b).tolist() and fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) < 1


def test_parse_finds_the_phrases():
    for text in ("", "a", "aaaaaaa", "abababababab", "größe größe größe", "the cat sat on the mat " * 30):
        parse = fp.Parse().read(text.encode())
        starts = [0, *parse.ends[:-1]]
        done = {(text.encode()[a:b], 0) for a, b in zip(starts, parse.ends, strict=True)} if parse.ends else set()
        assert done == {p for p in phrases(text) if not p[1]}
        assert fp.fingerprint(text).tolist() == plain_print(text)


def test_likeness_follows_shared_phrases(texts):
    some = [t for t in texts if t and len(t) > 60][:12]
    for a in some:
        for b in some:
            x, y = phrases(a), phrases(b)
            assert abs(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - len(x & y) / len(x | y)) < 0.2
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint(None)) == 1 and fp.likeness(fp.fingerprint(""), fp.fingerprint("a")) == 0
    assert len(fp.fingerprint("x" * 100_000)) <= fp.SIZE


def test_query_equals_brute_force(spark, docs, texts):
    got = sorted((tuple(r) for r in fp.fingerprint_with_edits(docs).collect()), key=repr)
    assert got == brute([*enumerate(texts), (5, texts[5])])


def test_odd_tables(spark, docs):
    assert fp.fingerprint_with_edits(docs.filter("false")).collect() == []
    for rows in ([(7, "only one text here")], [(7, None)], [(3, "b"), (3, "a"), (None, "x"), (None, None), (9, "zz")], [(1, "same")] * 5, [(1, f"text {k} of one id") for k in range(60)]):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted((tuple(r) for r in fp.fingerprint_with_edits(frame).collect()), key=repr) == brute(rows)


def test_edits_are_nearer_than_neighbours(docs):
    rows = [r for r in fp.fingerprint_with_edits(docs).collect() if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.1
