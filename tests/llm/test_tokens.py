import zlib

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import packing, pieces, textops, token_files


@pytest.fixture(scope="module")
def plain(vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_token_hashes(texts):
    data, offsets = textops.text_buffers(pa.array(texts))
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split() for t in texts]
    got = [textops.hash_tokens(data, offsets[a : b + 1]) for a, b in textops.slices(offsets, 500)]
    counts = np.concatenate([c for _, c in got]).tolist()
    hashes = np.concatenate([h for h, _ in got]).tolist()
    assert counts == [len(w) for w in low]
    of = dict(zip([w for t in low for w in t], hashes, strict=True))
    assert len(set(of.values())) == len(of) and hashes == [of[w] for t in low for w in t]


@pytest.mark.parametrize("keep", [600_000, 5])
def test_encoder_equals_library(texts, plain, vocabulary, keep):
    encoder = textops.CachedEncoder(vocabulary("byte_bpe_50k.json"), keep)
    odd = ["it's don't 'tis 'll", "a.,b,. c.. ,,", "Ǆž ɐb aɐ", "é́a", " .", " ,a", ".\n.", "a\n\n\nb", "  \n", "don't.  He'd, 'S", "1.5, 2.", "x ,y"]
    for part in (texts, odd, texts[::-1]):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(part)] == [plain(t) for t in part]


def test_token_files(spark, docs, texts, plain, vocabulary):
    for length, batch in ((64, 4), (2048, 256)):
        folder, manifest = token_files.write_token_files(docs, vocabulary("byte_bpe_50k.json"), 2, length, batch, parts=3)
        got = sorted(map(tuple, token_files.read_token_files(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
        rows = sorted([*enumerate(texts), (5, texts[5])], key=lambda x: x[0])
        want, start = [], 0
        for i, t in rows:
            ids = [*plain(t), 2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == sorted(want)
        stream = [x for i, t in rows for x in [*plain(t), 2]]
        read = []
        for r in sorted(manifest.collect()):
            file = token_files.TokenFile(folder, r["name"])
            for k in range(-(-r["n_tokens"] // length)):
                ids, mask = file.sequence(k)
                assert len(ids) == len(mask) == length and not ids.flags.owndata
                read += ids[mask.to_numpy(zero_copy_only=False)].tolist()
        assert read == stream


def test_token_files_of_nothing(spark, docs, vocabulary):
    folder, manifest = token_files.write_token_files(docs.filter("false"), vocabulary("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, folder, manifest).collect() == []
    folder, manifest = token_files.write_token_files(spark.createDataFrame([(None, None), (2, "a"), (None, "b")], "doc_id long, text string"), vocabulary("byte_bpe_50k.json"))
    assert [r["doc_id"] for r in sorted(token_files.read_token_files(spark, folder, manifest).collect(), key=lambda r: r["start"])] == [None, None, 2]


def test_one_doc_id_fills_many_files(spark, vocabulary):
    docs = spark.createDataFrame([(7 if k % 3 else k, f"text {k} " * 30) for k in range(300)], "doc_id long, text string")
    folder, manifest = token_files.write_token_files(docs, vocabulary("byte_bpe_50k.json"), parts=6)
    files = manifest.collect()
    assert len(files) == 6 and max(r["n_docs"] for r in files) < 80
    rows = sorted(token_files.read_token_files(spark, folder, manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows) and sum(r["n_tokens"] for r in rows) == rows[-1]["start"] + rows[-1]["n_tokens"]


def check_packing(rows, want):
    sequences, cover = {}, {}
    for doc_id, start, length, crc, total, sequence, offset in rows:
        ids = want[doc_id]
        assert total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) and length > 0
        sequences.setdefault(sequence, []).append((offset, length))
        cover.setdefault(doc_id, []).append((start, length))
    for parts, limit in [*((p, 2048) for p in sequences.values()), *((cover[k], None) for k in cover)]:
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert limit is None or end == limit or end & (end - 1) == 0
    assert {k: sum(n for _, n in v) for k, v in cover.items()} == {k: len(v) for k, v in want.items()}
    return sequences


def test_packing(docs, texts, plain, vocabulary):
    got = packing.pack_documents(docs.dropDuplicates(["doc_id"]).withColumn("sequence_id", docs.n_chars), vocabulary("byte_bpe_50k.json"))
    check_packing([tuple(r) for r in got.collect()], {i: [*plain(t), 1] for i, t in enumerate(texts)})
    assert packing.pack_documents(docs.filter("false"), vocabulary("byte_bpe_50k.json")).collect() == []


def test_groups_and_balance(monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 30_000)
    r = np.random.default_rng(2)
    want = {i: r.integers(0, 50_000, int(n)).tolist() for i, n in enumerate(r.lognormal(6, 1.3, 400) + 1)}
    packer = packing.Packer(7 << 36)
    for i, ids in want.items():
        packer.add(i, np.array(ids, "<u4").tobytes())
    packer.finish()
    sequences = check_packing(packer.rows, want)
    assert len(sequences) <= sum(map(len, want.values())) // 2048 + 12 and min(sequences) >= 7 << 36


def cost(n):
    return n + n * n / 512


def spread(costs):
    costs = np.array(list(costs))
    return costs.std() / costs.mean()


@pytest.mark.parametrize(("mean", "sigma"), [(6, 1.2), (5.5, 1), (5, 1), (6.5, 0.8), (4.5, 1.5)])
def test_costs_are_closer_than_by_concatenation(mean, sigma):
    for seed in range(3):
        lengths = (np.random.default_rng(seed).lognormal(mean, sigma, 1500) + 1).astype(int).tolist()
        packer, cut, at = packing.Packer(0), {}, 0
        for i, n in enumerate(lengths):
            packer.add(i, b"\0\0\0\0" * n)
            while n:
                take = min(n, 2048 - at % 2048)
                cut[at // 2048] = cut.get(at // 2048, 0) + cost(take)
                at, n = at + take, n - take
        packer.finish()
        packed, sizes = {}, {}
        for _, _, n, _, _, s, _ in packer.rows:
            packed[s], sizes[s] = packed.get(s, 0) + cost(n), sizes.get(s, 0) + n
        whole = [c for s, c in packed.items() if sizes[s] == 2048]
        assert len(whole) == sum(lengths) // 2048
        assert spread(whole) < 0.85 * spread([c for s, c in cut.items() if s < at // 2048])


def test_what_finds_no_room_is_cut_into_the_cheaper_gap_first():
    placed = packing.balance(np.array([1500, 1400, 600, 596]), 2)
    assert placed[3:] == [(3, 0, 548, 0), (3, 548, 48, 1)]
    assert packing.balance(np.array([1500, 1400, 600, 597]), 2)[-1] == (3, 596, 1, -1)


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 5000, 100_001])
def test_equal_parts(n):
    parts = packing.equal_parts(n)
    sizes = [b - a for a, b in parts]
    assert parts[0][0] == 0 and parts[-1][1] == n and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
    assert max(sizes) <= 2048 and max(sizes) - min(sizes) <= 1 and len(parts) == -(-n // 2048)


def brute_viterbi(model, word):
    known = {model.pieces[i]: (i, s) for i, (_, s) in enumerate(zip(model.pieces, [0] * len(model.pieces), strict=True))}
    scores = {}
    for end, (i, n, s) in model.automaton.iter(word):
        scores[end + 1 - n, end + 1] = (i, s)
    best = [0.0] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = [best[a] + scores[a, end][1] for a in range(end) if (a, end) in scores]
        if (end - 1, end) not in scores:
            options.append(best[end - 1] + model.unknown_score)
        best[end] = max(options)
    assert known
    return best[-1]


def test_sentencepiece(texts, docs, vocabulary):
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as proto

    path = vocabulary("piece_bpe_32k.model")
    model = pieces.PieceModel(path)
    pm = proto.ModelProto()
    with open(path, "rb") as f:
        pm.ParseFromString(f.read())
    pm.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    scores = {}
    for i, p in enumerate(pm.pieces):
        if p.type == 1:
            p.score = scores[i] = -float(np.log1p(-p.score))
    library = sp.SentencePieceProcessor(model_proto=pm.SerializeToString())

    def total(ids):
        return sum(scores.get(i, 0) for i in ids)

    for t in [t for t in texts if t and len(t) < 4000]:
        ids = np.frombuffer(model.encode(t), "<u4").tolist()
        assert total(ids) == pytest.approx(total(library.nbest_encode_as_ids(t, 1)[0]), abs=1e-2)
        assert model.decode(np.array(ids)) == library.decode(ids) == t
        for w in t.split()[:20]:
            assert brute_viterbi(model, "▁" + w) == pytest.approx(sum(scores.get(i, model.unknown_score if i < 259 and k == 0 else 0) for k, i in enumerate(model.viterbi("▁" + w))), abs=1e-6) or not w.isascii()
    coded = pieces.encode_pieces(docs.withColumn("ids", docs.lang), path)
    assert coded.columns == [*docs.columns, "ids"]
    back = pieces.decode_pieces(coded, path).collect()
    assert len(back) == len(texts) + 1 and all(r["decoded"] == r["text"] and (r["ids"] is None) == (r["text"] is None) for r in back)
    digests = {r["doc_id"]: r for r in pieces.piece_digests(docs, path).collect()}
    plain = sp.SentencePieceProcessor(model_file=path)
    for i, t in enumerate(texts):
        coded = model.encode(t)
        own = np.array(plain.encode(t or ""), "<u4")
        assert np.frombuffer(model.encode_both([t])[1][0], "<u4").tolist() == own.tolist()
        assert (digests[i]["n_library"], digests[i]["library_crc32"]) == (len(own), zlib.crc32(own.tobytes()))
        assert (digests[i]["n_pieces"], digests[i]["ids_crc32"], digests[i]["round_trip"]) == (len(coded) // 4, zlib.crc32(coded), True)
    assert pieces.piece_digests(docs.filter("false"), path).collect() == []


def test_long_words_are_not_remembered(vocabulary):
    model = pieces.PieceModel(vocabulary("piece_bpe_32k.model"))
    model.encode("short " + "x" * 100)
    assert "▁short" in model.known and max(map(len, model.known)) <= pieces.KEEP_CHARACTERS
