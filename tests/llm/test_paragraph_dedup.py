"""Operator 4 against all pairs of lines and a table of sentences."""

import random
import re

import pytest

from spanwise.llm import paragraph_dedup as dedup
from spanwise.llm.paragraph_dedup import CONTEXT, LINE_WORDS, MIN_WORDS, drop_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    """(word, line number, sentence number) of every word; sentences end at . ! ? and at line ends."""
    out, sentence = [], 0
    for n, line in enumerate(text.split("\n")):
        for w in WORD.findall(line.translate(LOWER)):
            out.append((w, n, sentence))
            sentence += w[-1] in ".!?"
        sentence += 1
    return out


def shingles(words):
    return set(zip(*(words[k:] for k in range(5)), strict=False))


def brute(rows):
    """Words removed per document, from the rules: sentences that occurred before, windows of MIN_WORDS words of
    an earlier document, in runs of MIN_WORDS words; and lines of LINE_WORDS words or more that are
    linked (Jaccard 0.75, chains included) with an earlier line.  Texts without hard-wrapped blocks."""
    docs = {i: words_of(t) for i, t in sorted(rows)}
    hit = {i: [False] * len(w) for i, w in docs.items()}
    seen, windows = set(), set()
    for i, w in docs.items():
        plain = [x for x, _, _ in w]
        starts = [k for k in range(len(w)) if k == 0 or w[k][2] != w[k - 1][2]]
        for a, b in zip(starts, [*starts[1:], len(w)], strict=True):
            key = tuple(plain[a : max(b, a + CONTEXT)])
            if key in seen:
                hit[i][a:b] = [True] * (b - a)
            seen.add(key)
        mine = [tuple(plain[k : k + MIN_WORDS]) for k in range(len(w) - MIN_WORDS + 1)]
        for k, x in enumerate(mine):
            if x in windows or x in mine[: max(0, k - MIN_WORDS + 1)]:
                hit[i][k : k + MIN_WORDS] = [True] * MIN_WORDS
        windows.update(mine)
    lines = []
    for i, w in docs.items():
        for n in sorted({n for _, n, _ in w}):
            at = [k for k, x in enumerate(w) if x[1] == n]
            if len(at) >= LINE_WORDS:
                lines.append((i, at, shingles([w[k][0] for k in at])))
    group = {k: {k} for k in range(len(lines))}
    for a in range(len(lines)):
        for b in range(a):
            x, y = lines[a][2], lines[b][2]
            if 4 * len(x & y) >= 3 * len(x | y) and group[a] is not group[b]:
                group[a] |= group[b]
                group.update(dict.fromkeys(group[a], group[a]))
    near = {i: set() for i in docs}
    for k, (i, at, _) in enumerate(lines):
        if min(group[k]) != k:
            near[i].update(at)
    gone = {}
    for i, w in docs.items():
        flags = [h or k in near[i] for k, h in enumerate(hit[i])]
        total = k = 0
        while k < len(w):
            end = k
            while end < len(w) and flags[end]:
                end += 1
            total += end - k if end - k >= MIN_WORDS else sum(x in near[i] for x in range(k, end))
            k = end + 1
        gone[i] = total
    return gone


def prose(rng, words):
    out = []
    while len(out) < words:
        n = rng.randrange(5, 15)
        out += [f"v{rng.randrange(10**6)}" for _ in range(n - 1)] + [f"v{rng.randrange(10**6)}."]
    return " ".join(out[:words])


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passage, other = prose(rng, 60), prose(rng, 55)
    edited = passage.split(" ")
    edited[20] = "edited"
    short = prose(rng, 12)
    texts = []
    for k in range(40):
        own = [prose(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(1, 4))]
        if k % 4 == 0:
            own.insert(rng.randrange(len(own) + 1), passage)  # a line of its own
        if k % 5 == 0:
            own[-1] += ". " + other  # inside a line
        if k % 7 == 0:
            own.append(" ".join(edited))  # a near copy
        if k % 2 == 0:
            own.append(short)  # a short line that many share
        texts.append("\n".join(own))
    texts += [texts[3], texts[3]]
    rows = [(10 * i + 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = drop_repeats(df).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.removed_words for r in out} == brute(rows)
    for r in out:
        assert sum(len(x.split()) for x in r.removed) == r.removed_words
        text = dict(rows)[r.doc_id]
        assert len(r.text.split()) == len(text.split()) - r.removed_words
        if not r.removed:
            assert r.text == text
    left = [r.text for r in out]
    assert sum(passage in t for t in left) == 1 and sum(other in t for t in left) == 1


def test_signature_recall_is_tuned():
    at = lambda s: 1 - (1 - s**dedup.ROWS) ** dedup.BANDS
    assert at(0.75) > 0.998


def test_edges(spark):
    passage = prose(random.Random(9), 51) + " now a last sentence of nine words ends it."
    rows = [(1, None, "a"), (2, "", "b"), (None, passage, "c"), (3, passage, "d"), (3, passage, "d"), (4, "x\n" + passage + "\ny", "e"),
            (5, ("word " * 30_000).strip(), "f"), (6, "Very! Common! Words! " * 30, "g"), (7, "Very! Common! Words! " * 3, "h"), (8, " \n \n", "i")]
    df = spark.createDataFrame([(*r, 1, ["old"]) for r in rows], "doc_id long, text string, doc string, units int, removed array<string>")
    out = drop_repeats(df)
    assert out.columns == ["doc_id", "text", "doc", "units", "removed", "removed_words"]
    got = {(r.doc_id, r.doc): (r.text, r.removed_words) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1, "a"] == (None, 0) and got[2, "b"] == ("", 0) and got[8, "i"] == (" \n \n", 0)
    assert got[None, "c"] == (passage, 0)  # without an id nothing is removed
    assert got[3, "d"] == (passage, 0)  # the first one stays, however often its row is there
    assert got[4, "e"] == ("x\ny", 60)
    assert got[5, "f"][1] == 0 and got[7, "h"][1] == 0
    assert drop_repeats(df.limit(0)).count() == 0


def test_whole_copies_become_empty(spark):
    passage = prose(random.Random(2), 80)
    df = spark.createDataFrame([(i, passage) for i in range(6)], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.removed_words) for r in drop_repeats(df).collect()} == {0: (passage, 0), **{i: ("", 80) for i in range(1, 6)}}


def plain(rng, words):
    return [f"v{rng.randrange(10**6)}" for _ in range(words)]


def earlier_windows(texts):
    """Per text the words inside a window of MIN_WORDS words that an earlier text has."""
    seen, out = set(), []
    for t in texts:
        w = WORD.findall(t.translate(LOWER))
        windows = [tuple(w[i : i + MIN_WORDS]) for i in range(len(w) - MIN_WORDS + 1)]
        out.append(len({k for i, x in enumerate(windows) if x in seen for k in range(i, i + MIN_WORDS)}))
        seen.update(windows)
    return out


def test_passages_inside_sentences(spark):
    rng = random.Random(11)
    shared = [plain(rng, n) for n in (39, 40, 52, 90, 150)]
    texts = []
    for k in range(30):
        words = plain(rng, rng.randrange(15))
        for p in rng.sample(shared, 2):
            words += p + plain(rng, rng.randrange(60, 90))  # no near copies
        if k % 3 == 0:  # sentence ends that differ between the copies
            words[rng.randrange(len(words))] += "."
        texts.append((" " if k % 2 else "\n" if k % 5 else "  ").join(words))
    want = earlier_windows(texts)
    got = {r.doc_id: r.removed_words for r in drop_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(want) > 1000
    assert got == dict(enumerate(want))


def test_a_passage_twice_in_one_text(spark):
    rng = random.Random(12)
    p, x, y = plain(rng, 60), plain(rng, 30), plain(rng, 30)
    (row,) = drop_repeats(spark.createDataFrame([(1, " ".join(x + p + y + p + x))], "doc_id long, text string")).collect()
    assert row.removed == [" ".join(p)] and row.text == " ".join(x + p + y + x)


def wrap(words, n):
    return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))


def test_wrapped_paragraphs_and_short_paragraphs(spark):
    rng = random.Random(13)
    p, short = plain(rng, 120), plain(rng, 28)
    edited = [f"x{i}" if i in (30, 60, 90) else w for i, w in enumerate(p)]  # no 40 equal words in a row
    other = [*short[:14], "edited", *short[15:]]
    own = [wrap(plain(rng, 70), 11) for _ in range(5)]
    rows = [(0, f"{own[0]}\n\n{wrap(p, 12)}\n\n{' '.join(short)}"), (1, f"{own[1]}\n\n{wrap(edited, 12)}"), (2, f"{wrap(edited, 14)}\n \n{own[2]}"),
            (3, f"{own[3]}\n{' '.join([*short, 'more'])}\n{own[3][:20]}"), (4, f"{wrap(other, 10)}\n\n{own[4]}")]
    got = {r.doc_id: r for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].removed_words == 0
    assert got[1].removed == [wrap(edited, 12)] and got[1].text.strip() == own[1]
    assert got[2].removed == [wrap(edited, 14)] and got[2].text.strip() == own[2]
    assert got[3].removed == [" ".join([*short, "more"])]
    assert got[4].removed_words == 0  # Jaccard under 0.75: one of 28 words differs


def test_copies_of_short_paragraphs(spark):
    """A line of 20 to 39 words goes when it comes again, copied exactly or nearly, and whatever else is linked."""
    rng = random.Random(15)
    line, other = plain(rng, 28), plain(rng, 36)
    near = [*line[:27], "edited"]
    below = plain(rng, LINE_WORDS - 1)
    own = [" ".join(plain(rng, 30)) for _ in range(8)]
    rows = [(0, f"{own[0]}\n{' '.join(line)}"), (1, f"{own[1]}\n{' '.join(line)}\nend"), (2, f"{' '.join(near)}\n{own[2]}"), (3, f"{own[3]}\n{' '.join(other)}"),
            (4, f"{own[4]}\n{' '.join(other)}"), (5, f"{own[5]}\n{' '.join(below)}"), (6, f"{own[6]}\n{' '.join(below)}"), (7, f"{' '.join(other)}\nx y\n{' '.join(other)}")]
    got = {r.doc_id: (r.removed_words, r.text) for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: n for i, (n, _) in got.items()} == {0: 0, 1: 28, 2: 28, 3: 0, 4: 36, 5: 0, 6: 0, 7: 72}
    assert got[1][1] == f"{own[1]}\nend" and got[2][1] == own[2] and got[7][1] == "x y"


def test_a_block_does_not_remove_its_own_line(spark):
    rng = random.Random(14)
    text = "a b\n" + " ".join(plain(rng, 30)) + "\nc d\ne f"
    assert [r.removed_words for r in drop_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == [0]
