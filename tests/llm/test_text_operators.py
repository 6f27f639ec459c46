import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.llm import chat_format as C
from quernel.llm import decontaminate as D
from quernel.llm import line_dedup as LD
from quernel.llm import secrets as S
from quernel.llm import sharding as SH

DOCS = "doc_id long, text string"


# -- decontamination -------------------------------------------------------------------------------------------------
def plain_words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain_leak(text, items, window=13):
    w, hit, found = plain_words(text), set(), set()
    for name, t in items:
        iw = plain_words(t)
        k = min(window, len(iw))
        wins = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if iw else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(name)
    return len(w), len(hit), sorted(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=9), max_size=5), st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 5))
def test_automaton_equals_brute_force(items, words, window):
    named = [(str(i), " ".join(x)) for i, x in enumerate(items)]
    spans, found = D.ItemAutomaton(named, window).scan([x.encode() for x in words])
    assert (len(words), sum(b - a + 1 for a, b in spans), sorted(found)) == plain_leak(" ".join(words), named, window)


def test_contamination_of_tables(table):
    item = "One two, three-four FIVE six seven eight nine ten eleven twelve thirteen fourteen"
    items = [("i1", item), ("i2", "short École item"), ("i3", None), ("i4", "  "), (None, "zz yy xx")]
    docs = [(1, f"before {item.lower()} after" + " and more of its own" * 4), (2, "a short école ITEM! here"), (3, None), (4, ""), (5, "nothing of it"), (5, "nothing of it"), (6, "x " * 5000 + item), (7, item), (None, "zz yy xx and more words than that")]
    d, b = table(docs, DOCS, ["leak", "spans"]), table(items, "item_id string, text string")
    expected = sorted((str(i), *plain_leak(t, [(n or "null", x) for n, x in items])) for i, t in docs)
    for most in (10**6, 40):  # one automaton, and slices
        got = D.contamination(d, b, most_item_chars=most).collect()
        assert sorted((str(r.doc_id), r.leak.n_words, r.leak.n_hit, list(r.leak["items"])) for r in got) == expected
        clean = {r.doc_id: r.text for r in D.decontaminate(d, b, most_item_chars=most).collect()}
        assert set(clean) == {1, 2, 3, 4, 5, 6, None} and len(clean[6].split()) == 5000
        assert clean[1].startswith("before  after and") and clean[3] is None and clean[5] == "nothing of it"
    assert D.contamination(table([], DOCS), b).count() == 0
    assert {r.leak.n_hit for r in D.contamination(d, table([], "item_id string, text string")).collect()} == {0}


@pytest.mark.parametrize("line, value", [
    ("DB_PWD=hunter2longvalue99", "hunter2longvalue99"), ("pwd: hunter2abcdEFG99", "hunter2abcdEFG99"), ("AWS_SESSION_KEY=AbCdEf1234567890xyz", "AbCdEf1234567890xyz"), ("auth = Zx9qW7rT2abc", "Zx9qW7rT2abc"),
    ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzz", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzz"),
])
def test_configuration_values(line, value):
    for text in (line, f"# settings\n{line}\nother = 1\n", f"[section]\n  {line}"):
        assert any(text[a:b].endswith(value) for _, a, b in S.all_spans(text)[1])


def test_long_and_repetitive_texts_take_time_in_proportion():
    import time

    chain = 'pwd0 = "s3cretPart9x"\n' + "".join(f"pwd{i} = pwd{i - 1} + pwd{i - 1}\n" for i in range(1, 20_000))
    hard = {
        "chain": chain, "quotes": 'token = "' + '\\"' * 300_000, "calls": "key=" * 200_000 + "(", "known": 'key="aaaaBBBB1111"\n' + "key=" * 200_000, "many": "api_key = 'abcd1234EFGH'\n" * 20_000,
        "types": "pwd: A[" * 100_000, "blanks": "pwd " + " " * 500_000 + "x", "name": "a" * 500_000 + "pwd = 'abcd1234EFGH'", "dots": "a." * 200_000, "one": "'" * 300_000 + '"' * 300_000 + "pwd",
    }
    for name, text in hard.items():
        begin = time.process_time()
        S.all_spans(text)
        assert time.process_time() - begin < 20, name
    assert [chain[a:b] for _, a, b in S.literal_spans(chain)] == ["s3cretPart9x"]
    assert len(S.all_spans(hard["many"])[1]) == 20_000


# -- line dedup ---------------------------------------------------------------------------------------------------------
def test_lines_equal_brute_force(table):
    texts = [f"Shared line\nown {i}\n\n  SHARED LINE \t\nÉ{i % 2}" for i in range(6)] + [None, "", "\n\n", "shared line", "a\x0b", "É0\né0\nown 3"]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    fold = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen.setdefault(fold(x), set()).add(i)
    gone = {k for k, v in seen.items() if k and len(v) >= 3}
    expected = sorted((i, len((t or "").split("\n")), sum(fold(x) in gone for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if fold(x) not in gone)) for i, t in rows)
    got = LD.line_dedup(table(rows, DOCS, ["n_lines", "_k1", "_drop"]), min_docs=3)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == expected
    assert LD.line_dedup(table([], DOCS)).count() == 0
    assert LD.line_dedup(table([(None, "x"), (None, "x"), (1, "x")], DOCS), min_docs=1).where("n_dropped = 1").count() == 3


# -- secrets ------------------------------------------------------------------------------------------------------------
BASE = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))


def plain_base(text):
    out = []
    for k, (kind, p) in enumerate(BASE):
        for m in re.finditer(p, text, re.ASCII | re.IGNORECASE if kind == "assign" else re.ASCII):
            size = m.end(2) - m.start(2) if kind == "assign" else m.end() - m.start()
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "toKen", "api_key", "=", ": ", "'", '"', "abcdefgh", "0123456789abcdef" * 2, "AKIA", "A1B2C3D4E5F6", " ", "é", "\n", "ſecret", "Secret="]), max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    base, spans = S.all_spans(text)
    assert [f"{k}:{a}:{b}" for k, a, b in base] == plain_base(text)
    assert set(base) <= set(spans)


def test_lexer_propagates_constants_and_scores(table):
    text = 'part = "Zx9q"\nalias = part + "W7rT2"\nDB_PASSWORD = alias\nclient_secret: str = "a8Fh2kQ9"\nname = "Zx9qW7rT2"\npwd = "your_password"\n'
    literal = [text[a:b] for k, a, b in S.literal_spans(text)]
    assert literal == ["Zx9q", "W7rT2", "a8Fh2kQ9"]
    got = S.scan(table([(1, text), (2, None), (3, "")], DOCS, ["secrets"])).collect()
    assert {r.doc_id: r.secrets.spans for r in got if r.doc_id > 1} == {2: "", 3: ""}
    assert "a8Fh2kQ9" not in S.redact(text, S.all_spans(text)[1])
    assert S.scan(table([], DOCS)).count() == 0


@pytest.mark.parametrize(
    ("line", "value"),
    [
        ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzz", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzz"),
        ("DB_PWD=Hunter2Xyzzy99 # the old one", "Hunter2Xyzzy99"),
        ("db:\n  pwd: Hunter2Xyzzy99\n  host: h", "Hunter2Xyzzy99"),
        ("[db]\npwd = Hunter2Xyzzy99; note", "Hunter2Xyzzy99"),
        ('var dbPwd string = "Hunter2Xyzzy99"', "Hunter2Xyzzy99"),
        ('var dbPwd []byte = "Hunter2Xyzzy99"', "Hunter2Xyzzy99"),
        ('let db_pwd: &str = "Hunter2Xyzzy99";', "Hunter2Xyzzy99"),
        ("let db_pwd: &'static str = \"Hunter2Xyzzy99\";", "Hunter2Xyzzy99"),
        ('pwd: Optional[str] = "Hunter2Xyzzy99"', "Hunter2Xyzzy99"),
        ('String dbPwd = "Hunter2Xyzzy99";', "Hunter2Xyzzy99"),
        ("pwd = read_password_1(path)", None),
        ("pwd = self.settings.databasePassword", None),
    ],
)
def test_values_without_quotes_and_typed_targets(line, value):
    assert [line[a:b] for _, a, b in S.literal_spans(line)] == ([value] if value else [])


HARD = "Zx9qW7rT2"


@pytest.mark.parametrize(
    ("line", "found"),
    [
        ('pwd = "' + "a" * 300 + '"', False),
        ('pwd = "' + "a" * 300 + HARD + '"', True),  # what makes it a secret comes late
        ("pwd=" + "a" * 300 + HARD, True),
        ('pwd = "' + HARD * 40 + ' and plain words"', False),  # as does what shows that it is none
        ('pwd = "<' + HARD * 40 + '>"', False),
        ('pwd = "${' + HARD * 40 + '}"', False),
        ('pwd = "your-' + HARD * 40 + '"', False),
        ('pwd = "your-' + HARD * 40 + '/"', True),
        ('pwd = "' + "x" * 300 + '"', False),
        ('pwd = "' + "ab" * 200 + "cdefghijklmnop" * 30 + '"', True),  # by its entropy
        ('a = "' + "a" * 300 + '"\nb = a + "' + HARD + '"\npwd = b', True),
        ("c" * 300 + f' = "{HARD}"\npwd = ' + "c" * 300, True),
        (f"pwd = {HARD}" + " " * 100 + "+ x", False),
    ],
)
def test_the_whole_value_counts(line, found):
    assert bool(S.literal_spans(line)) == found


def plain_score(name, value):
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    weight = S.name_weight(name)
    if weight == 0 or len(value) < 6 or S._PLACEHOLDER.fullmatch(value) or " " in value.strip():
        return 0.0
    return weight + (len(value) >= 16) + (classes >= 2) + (classes >= 3) + (S.entropy(value) >= 3.0)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 9), st.sampled_from(["", " ", "\t", "a", "x", "X" * 9, "*" * 20, "....", "your", "example-", "$", "${", "}", "%", "<", ">", "a1" * 9, "B_", "é", "abcdefgh", "-"])), min_size=1, max_size=4), min_size=1, max_size=7))
def test_scores_of_joined_values_equal_those_of_their_texts(rows):
    """Each row is a constant of literals and earlier constants; every node scores like the text it stands for."""
    lines, values = [], []
    for i, row in enumerate(rows):
        parts = [x % i if isinstance(x, int) and i else str(x) for x in row]
        lines.append(f"v{i}_key = " + " + ".join(f"v{x}_key" if isinstance(x, int) else f'"{x}"' for x in parts))
        values.append("".join(values[x] if isinstance(x, int) else x for x in parts))
    got = S.Assignments("\n".join(lines))
    assert [name for name, _ in got.pairs] == [f"v{i}_key" for i in range(len(rows))]
    for (name, node), value in zip(got.pairs, values, strict=True):
        assert S.score(name, value) == plain_score(name, value)
        for target in (name, "pwd", "client_id", "client_secret", "host"):
            for least in range(8):
                assert got.reaches(target, node, least) == (plain_score(target, value) >= least)


def test_work_on_values_is_in_proportion_to_the_text():
    """Constants that double on each line, long chains, and many names of one long value; entropy decides in all of them."""
    n = 5000
    doubled = '\n'.join(['key0 = "aB1"', *(f"key{i} = key{i - 1} + key{i - 1}" for i in range(1, n))])
    chain = '\n'.join(['pwd0 = "abababababababababab"', *(f'pwd{i} = pwd{i - 1} + "ab"' for i in range(1, n))])
    names = '\n'.join(['part = "' + "ab" * 100_000 + '"', *(f"pwd{i} = part" for i in range(n))])
    for text, found in ((doubled, 0), (chain, 0), (names, 0), (chain + '\npwd = pwd0 + "cdefghijklmnopqr"', 2)):
        began = time.process_time()
        assert len(S.literal_spans(text)) == found
        assert time.process_time() - began < 5


# -- chat formatting ----------------------------------------------------------------------------------------------------
NASTY = st.lists(st.sampled_from([*C.CONTROL, "\\", "[", "<", "INST]", "</s", " ok ", "é", "\n", "[INST] x [/INST]"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "</s>", ""]), NASTY), max_size=5))
def test_template_round_trip_and_loss(turns):
    t = C.Template()
    text, spans, rewrites = C.turn_spans(t, turns)
    assert t.parse(text) == turns and not rewrites
    assert [t.unescape(text[c:d]) for (_, _, c, d), (r, _) in zip(spans, turns) if r == "assistant"] == [x for r, x in turns if r == "assistant"]
    assert [s[0] for s in spans[1:]] == [s[1] for s in spans[:-1]]


def test_rewriting_and_tailed_templates():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    last_only = lambda ts: "".join(f"<{r}>{x if i == len(ts) - 1 or r == 'user' else '...'}" for i, (r, x) in enumerate(ts))
    assert C.turn_spans(last_only, turns)[2]
    tailed = lambda ts: "".join(f"<{r}>{x}" for r, x in ts) + "<END>"
    text, spans, rewrites = C.turn_spans(tailed, turns)
    assert not rewrites and [text[c:d] for _, _, c, d in spans] == ["", "b", "", "d"]


@pytest.mark.parametrize("block", [3, 32])
def test_conversations(table, block):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} </s>") for t in range(11)] + [(2, 0, "user", None), (2, 1, None, "x"), (2, 1, "assistant", ""), (None, None, "assistant", "n"), (3, 5, "user", "late"), (3, 5, "user", "late")]
    frame = table(rows, "conv_id long, turn long, role string, text string", ["part", "spans"])
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(frame, block=block)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        assert got[conv].n_turns == len(turns) and not got[conv].rewrites
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == len(C.Template()(turns))
    assert C.read_back(C.format_conversations(frame.where("false"))).count() == 0


# -- sharding -----------------------------------------------------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=12), st.integers(1, 5))
def test_smallest_capacity_is_minimax(sizes, shards):
    best = {0: 0}
    for _ in range(shards):
        best = {j: min((max(best[i], sum(sizes[i:j])) for i in best if i <= j), default=10**9) for j in range(len(sizes) + 1)}
    assert SH.smallest_capacity(sizes, shards) == best[len(sizes)]


def test_shards_are_minimax_over_digests(table):
    texts = [f"text {i} " * (i % 17) for i in range(400)] + ["hot text " * 30] * 150 + [None, "", "é" * 40]
    out = SH.shard(table(list(enumerate(texts)), DOCS, ["slot", "_part"]), 8, slot_parts=4).collect()
    assert len(out) == len(texts) and all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in out)
    groups = Counter()
    for t in texts:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    loads = Counter()
    for r in out:
        loads[r.shard] += r.size
    assert max(loads.values()) == SH.smallest_capacity([groups[k] for k in sorted(groups)], 8)
    assert all(len({r.shard for r in out if (texts[r.doc_id] or "") == t}) == 1 for t in {x or "" for x in texts})
    for s in set(loads):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert SH.shard(table([], DOCS), 8).count() == 0
