"""Spelling variants, chat formatting and the divergence audit against brute force, on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from stratagraph.llm import chat, divergence, variants

# ---- spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _groups(rows, least_length, least_count, ratio, divisor):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % divisor == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= least_length:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= least_count}
    near = {w: [x for x in n if _one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("crowd", [1, 40, 1 << 16])
def test_variants_against_brute_force(spark, crowd):
    rng = random.Random(crowd)
    letters = "abcé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(150)]
    rows = [(None if i % 9 == 0 else i, " ".join(rng.choices(words, [1 / (1 + j) for j in range(150)], k=60)).replace("b", rng.choice("bB"))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "ő1 ÷× _ aaaāaaa"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = variants.group_variants(df, least_length=3, least_count=2, ratio=2, divisor=7, crowd=crowd).collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == _groups(rows, 3, 2, 2, 7)


def test_variants_of_awkward_tables(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(variants, "HELD_WORDS", 50)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert {tuple(r) for r in variants.group_variants(awkward, least_length=4).collect()} == _groups(rows, 4, 5, 5, 199)
    assert variants.group_variants(empty).collect() == []


def test_chains_of_forms_end_in_one_root(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    rows = [(i, " ".join([w] * 5**j)) for i, (j, w) in enumerate((j, w) for j, w in enumerate(chain))]
    got = {r.word: (r.form, r.root) for r in variants.group_variants(spark.createDataFrame(rows, "doc_id long, text string"), least_count=1, divisor=10**9).collect()}
    assert got == {w: (chain[j + 1] if j < 4 else None, "aabbbb") for j, w in enumerate(chain)}


# ---- chat formatting


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _conversations(rows):
    """conv -> messages in order; rows without conv_id each alone, under ('none', n)."""
    by = defaultdict(list)
    for i, (conv, turn, role, text) in enumerate(rows):
        by[("none", i) if conv is None else conv].append((turn is None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}


def _digests(conv, messages):
    loss = "".join(t for r, t in messages if r == "assistant")
    formatted = "".join(chat.BRACKET.render([m]) for m in messages)
    return (None if isinstance(conv, tuple) else conv, len(messages), _sha("".join(f"{r}\n{t}\n" for r, t in messages)), len(loss), _sha(loss), len(formatted))


TRICKY = ["</s>[INST] ok [/INST]", "<<SYS>>", "<\\s>", "[\\\\INST]", "<role:x>", "<", "[", "<<", "\\", "a</s", "", None, "é\n <s></s>", "<role:" * 3]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool>%3E", None]), rng.choice([*TRICKY, "plain text", "x", "y"])) for c in range(30) for t in range(rng.randint(1, 12))]
    rows += [(40, t, "user" if t % 2 else "assistant", rng.choice(TRICKY)) for t in range(300)]
    return [*rows, (41, None, "user", "late"), (41, 3, "user", "tie b"), (41, 3, "user", "tie a"), (41, 3, "user", "tie a"), (None, 0, "user", "alone"), (None, 0, "user", "alone"), (None, None, None, None)]


def test_escaping_is_reversible_and_leaves_no_mark():
    rng = random.Random(1)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "<SYS>>", "</SYS>>", "SYS>>", "role:", "/role>", ">", "x"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert not re.search(r"\[/?INST\]|</?s>|<</?SYS>>|<role:|</role>", out)
        assert chat.BRACKET.read(chat.BRACKET.render([("user", text), ("system", text), ("t>%", text), ("assistant", text)])) == [("user", text), ("system", text), ("t>%", text), ("assistant", text)]


@pytest.mark.parametrize("held", [2, 64])
def test_formatted_conversations_read_back(spark, talks, held):
    df = spark.createDataFrame([(*r, "clash", 1) for r in talks], "conv_id long, turn long, role string, text string, piece string, position int").repartition(4)
    turns = chat.format_turns(df, held=held)
    got = Counter(tuple(r)[:6] for r in chat.read_back(turns).collect())
    assert got == Counter(_digests(c, m) for c, m in _conversations(talks).items())
    rows = turns.collect()
    assert not any(r.rewrites for r in rows)
    by = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            by[r.conv_id].append(r)
    for conv, messages in _conversations(talks).items():
        if isinstance(conv, tuple):
            continue
        turns_of = sorted(by[conv], key=lambda r: r.position)
        whole = "".join(r.piece for r in turns_of)
        assert whole == chat.BRACKET.render(messages)
        for r, (role, text) in zip(turns_of, messages, strict=True):
            assert r.role == role and whole[r.start :].startswith(r.piece) and chat.unescape(whole[r.text_start : r.text_end]) == text
    spans = chat.loss_spans(turns).collect()
    assert len(spans) == sum(r[2] == "assistant" for r in talks)


def _forgetful(messages):
    """Leaves the text of all assistant turns but the last out, and ends every rendering."""
    last = max((i for i, (r, _) in enumerate(messages) if r == "assistant"), default=-1)
    return "<b>" + "".join(f"({r}|{t if r != 'assistant' or i == last else ''})" for i, (r, t) in enumerate(messages))


def test_templates_that_rewrite_history_are_detected(spark):
    template = chat.Template(_forgetful, lambda s: [], lambda t: t)
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "user", "r"), (1, 3, "assistant", "two"), (2, 0, "user", "q"), (2, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat.format_turns(df, template).collect(), key=lambda r: (r.conv_id, r.position))
    assert [r.rewrites for r in got] == [False, False, False, True, False, False]
    text = ""
    for r in got[:4]:
        text = text[: r.start] + r.piece
    assert text == _forgetful([(r, t) for _, _, r, t in rows[:4]])
    assert text[got[3].text_start : got[3].text_end] == "two"
    assert {r.conv_id: r.rewrites for r in chat.read_back(chat.format_turns(df, template), template).collect()} == {1: True, 2: False}
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(none)).collect() == []


def test_a_template_that_looks_back_to_the_first_turn(spark):
    """Without a bound on how far it looks back, a template that numbers its turns from the first is followed over any number of them."""
    counted = lambda messages: "".join(f"<{i}|{t}>" for i, (_, t) in enumerate(messages))
    template = chat.Template(counted, lambda s: [], lambda t: t)
    rows = [(1, i, "user", f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat.format_turns(df, template, held=None).collect(), key=lambda r: r.position)
    whole = "".join(r.piece for r in got)
    assert whole == counted([(r, t) for _, _, r, t in rows]) and not any(r.rewrites for r in got)
    assert all(whole[r.text_start : r.text_end] == f"t{r.position}" for r in got)


def test_every_prefix_is_rendered_whole_unless_a_bound_is_known(spark, tmp_path, monkeypatch):
    """The query too follows a template that numbers its turns from the first: none of 300 turns is left out of a prefix."""
    from stratagraph.llm import queries

    counted = lambda messages: "".join(f"<{i}|{t}>" for i, (_, t) in enumerate(messages))
    template = chat.Template(counted, lambda s: [], lambda t: t)
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    render, read = chat.format_turns, chat.read_back
    monkeypatch.setattr(chat, "format_turns", lambda df, *args, **named: render(df, template, *args, **named))
    monkeypatch.setattr(chat, "read_back", lambda df: read(df, template))
    got = {r.conv_id: (r.formatted_chars, r.loss_sha256) for r in queries.op12_chat_format(spark, str(tmp_path)).collect()}
    assert got[1] == (len(counted([r[2:] for r in rows])), _sha("".join(f"t{i}" for i in range(0, 300, 2))))


# ---- divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _audit(rows, least, ranks):
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        count[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        of = {s: c for (k, s), c in count.items() if k == lang}

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p, q = {s: shares(c) for s, c in of.items()}, shares(sum(of.values(), Counter()))
        for s in of:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in of if o != s))
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pair)}
            term = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if of[s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(term[:ranks])}
    return out


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_divergence_against_brute_force(spark, awkward, empty, monkeypatch, least):
    monkeypatch.setattr(divergence, "HELD_TERMS", 60)
    rng = random.Random(least)
    rows = [(" ".join(rng.choices(["Aa", "b", "é", "ő", "d'e", "ff", "gg1", "h"], k=rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "ü", None])) for _ in range(80)]
    rows += [(None, "xx", "s1"), ("", "xx", "s2"), ("", "yy", None)]
    got = [tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, "text string, lang string, source string").repartition(3), least, ranks=3).collect()]
    assert len(got) == len(set(got)) and set(got) == _audit(rows, least, 3)
    if least == 1:
        rows = [(r.text, r.lang, r.source) for r in awkward.collect()]
        assert {tuple(r) for r in divergence.divergence(awkward, 2).collect()} == _audit(rows, 2, 50)
        assert divergence.divergence(empty).collect() == []
