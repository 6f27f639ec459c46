import os
import random

import pytest

from quernel.llm import sentencepiece_codec as P

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary")


def best_score(text, codec):
    """All segmentations by dynamic programming over whole prefixes."""
    best = [(0.0, [])] + [None] * len(text)
    for n in range(1, len(text) + 1):
        for j in range(n):
            p = text[j:n]
            if best[j] and (p in codec.score or n - j == 1):
                s = best[j][0] + codec.score.get(p, codec.worst)
                if best[n] is None or s > best[n][0]:
                    best[n] = (s, best[j][1] + [p])
    return best[-1][0]


def test_unigram_is_the_best_segmentation():
    rng = random.Random(4)
    pieces = [("<unk>", 0.0, P.UNKNOWN)] + [(x, -rng.random() * 8 - len(x) * 0.1, P.NORMAL) for x in ["a", "b", "c", "▁", "ab", "bc", "abc", "▁a", "▁ab", "cab", "ba", "aa", "aaaa"]]
    codec = P.Codec(pieces, P.UNIGRAM, byte_fallback=False)
    for _ in range(200):
        text = "".join(rng.choice("abcz▁") for _ in range(rng.randint(1, 90)))
        got = list(codec.segment(text))
        assert "".join(got) == text
        assert abs(sum(codec.score.get(p, codec.worst) for p in got) - best_score(text, codec)) < 1e-9


def test_stream_commits_in_a_bounded_window():
    codec = P.Codec([(x, -float(i + 1), P.NORMAL) for i, x in enumerate(["a", "b", "ab", "ba"])], P.BPE)
    assert "".join(codec.segment("ab" * 5000 + "b")) == "ab" * 5000 + "b"
    assert codec.commits > 1000 and codec.widest <= 4 * codec.longest
    # a unit goes on from what it shares with the one before, committed or in the window
    units = sorted({"ab" * n + x for n in (1, 3, 40, 41, 300) for x in ("", "a", "b", "bb", "ba")})
    assert ["".join(p) for p in codec.stream(units)] == units
    assert list(codec.stream(units)) == [codec.segment(u) for u in units]


@needs_model
def test_the_encoder_commits_at_meeting_points():
    """What encodes the corpus is the stream: every unit ends in a commit, long ones hold more, and the window stays small."""
    import sentencepiece

    codec, library = P.Codec.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(4000)), "some plain words and more of them", "=" * 3000 + "日本語" * 500]
    assert codec.encode_many(texts) == [library.encode(t) for t in texts]
    units = {u for t in texts for u in codec.unit.findall(P.SPACE + t.replace(" ", P.SPACE))}
    assert codec.commits > len(units) + 20 and codec.widest <= 4 * codec.longest
    before = codec.commits
    assert codec.encode_many(texts[1:2]) == [library.encode(texts[1])] and codec.commits == before  # from the memo of the stream
    assert codec.encode_many([texts[0], texts[0]]) == [library.encode(texts[0])] * 2


@needs_model
def test_ids_equal_the_library_and_come_back(spark):
    import sentencepiece

    codec, library = P.Codec.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    texts = ["", " ", "a  b   c", "日本語 テスト", "🙂 x\ty\r\n", "x" * 500, "     foo     bar", " " * 40 + "z", "\n\n  \n", "aaaabbbb" * 50, "İstanbul ſß"]
    texts += ["".join(rng.choice("aeinrst  hélo.0123\n") for _ in range(rng.randint(1, 200))) for _ in range(300)] + ["".join(rng.choice("abcdefghij") for _ in range(300)) for _ in range(20)]
    for t in texts:
        assert codec.encode(t) == library.encode(t)
        assert codec._ids(codec.segment("▁" + t.replace(" ", "▁")) if t else []) == library.encode(t)  # without units
        assert codec.decode(codec.encode(t)) == t
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None, "a▁b"])] + [(0, "", 1)], "doc_id long, text string, n_ids int")
    got = {r.doc_id: r for r in P.encode(frame, MODEL).collect()}
    assert all(list(got[i].ids) == library.encode(t) and got[i].round_trip for i, t in enumerate(texts))
    assert got[len(texts)].n_ids == 0 and got[len(texts)].round_trip is None and got[len(texts) + 1].round_trip is False
    assert P.encode(frame.where("false"), MODEL).count() == 0


@needs_model
def test_memory_does_not_grow_with_the_length_of_texts(spark, monkeypatch):
    """Many long texts are taken a few at a time, and their units in blocks; the memo is bounded by what it holds."""
    seen = []
    many = P.Codec.encode_many
    monkeypatch.setattr(P.Codec, "encode_many", lambda self, texts: seen.append(sum(len(t or "") for t in texts)) or many(self, texts))
    monkeypatch.setattr(spark.sparkContext.__class__, "broadcast", lambda self, value: type("Local", (), {"value": value})())
    frame = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    tasks = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, work, schema: tasks.append(work) or self)
    P.encode(frame, MODEL)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(100_000)) for _ in range(8)] + [None, ""]
    batch = P.pa.RecordBatch.from_pydict({"doc_id": list(range(10)), "_text": texts})
    made = [r for b in tasks[0](iter([batch])) for r in b.to_pylist()]
    assert [r["round_trip"] for r in made] == [True] * 8 + [None, True] and [r["doc_id"] for r in made] == list(range(10))
    assert max(seen) < 3_000_000 and sum(seen) == sum(len(t or "") for t in texts)


@needs_model
def test_blocks_and_a_full_memo_change_no_ids(monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(P, "UNITS", 50)
    monkeypatch.setattr(P, "MEMO_CHARS", 2000)
    codec, rng = P.Codec.load(MODEL), random.Random(3)
    words = ["".join(rng.choices("abcdefgh日本ü", k=rng.choice((1, 5, 30, 60, 90)))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=n)) + end for n in (0, 1, 49, 50, 51, 400) for end in ("", "\n\n", "  x")]
    for _ in range(2):
        assert codec.encode_many([*texts, None]) == [*map(library.encode, texts), []]
        assert sum(map(len, codec.memo)) <= 2000 + 51 * 64 + 1000 and all(len(u) <= 4 * codec.longest for u in codec.memo)
        assert sum(map(len, codec.memo)) == codec.memo_chars
