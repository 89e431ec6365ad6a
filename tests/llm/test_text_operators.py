import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codegauge.llm import line_dedup, quality_rules, token_files, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, kept string, h string, n_words int"
PROSE = "the quick brown fox jumps over a lazy dog while nine small birds sing about rain and sun in the early morning"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "k", "h", 3) for i, t in rows], DOCS)


def brute_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count = Counter(windows)
    inside = {j for k, x in enumerate(windows) if count[x] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


TEXTS = [None, "", " \n ", PROSE, PROSE + " " + PROSE, PROSE + "\n" + PROSE + "\n\n" + PROSE, "a b c d e f g h a b c d e f g h", "é ü x " * 30, "$$$ *** | " * 40, "w " * 30_000, "x" * 100_000, "That That That " * 20, "BIG SHOUTING WORDS OF ALL SORTS AND KINDS ARE HERE TO BE SEEN BY THE READER WHO READS THEM NOW OK"]


def test_quality_statistics_and_verdicts(spark):
    docs = table(spark, [*enumerate(TEXTS), (3, PROSE), (None, PROSE)])
    got = {(r.doc_id, i): r for i, r in enumerate(quality_rules.judged(docs).orderBy("doc_id").collect())}
    assert len(got) == len(TEXTS) + 2
    for (i, _), r in got.items():
        text = PROSE if i is None else TEXTS[i]
        n, *rest = brute_stats(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[3] > 30 * n)
        assert not (r.base_failed and r.kept)
        assert r.kept == (text == PROSE)
    kept = quality_rules.kept_rows(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([3, 3, None])
    assert quality_rules.judged(docs.limit(0)).count() == 0 and quality_rules.kept_rows(docs.limit(0)).count() == 0


def test_rule_order_does_not_change_the_verdict():
    for t in TEXTS:
        x = quality_rules.Text(t)
        assert {quality_rules.first_rejection(x, p) is None for p in (quality_rules.RULES, quality_rules.RULES[::-1])} in ({True}, {False})


LONG = " ".join(f"word{i}" for i in range(60)).replace("0", "o").replace("1", "l")
LONG = " ".join("".join(chr(97 + (i * 7 + j * 3) % 26) for j in range(5)) for i in range(26)) + " and then some more words follow"


def test_lines_repeat_once(spark):
    short = "too short line"
    rows = [
        (2, f"{LONG}\n{short}\nan own line that nobody else has in store"),
        (1, f"first of all comes a line of its own\n{LONG}!\n{short}"),
        (3, LONG.upper() + " 123"),
        (4, None),
        (5, ""),
        (6, "first of all comes a line of its own\nfirst of all comes a line of its own\n\n  \n"),
    ]
    docs = table(spark, [*rows, (5, "")])
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter({(1, rows[1][1]): 1, (2, f"{short}\nan own line that nobody else has in store"): 1, (3, ""): 1, (4, None): 1, (5, ""): 2, (6, "\n  \n"): 1})
    assert {r.doc_id for r in line_dedup.without_repeats(docs, drop_empty=True).collect()} == {1, 2, 4, 5}
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0


def test_fuzzy_lines_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    lines = []
    for _ in range(40):
        base = list(rng.choice(words, 90, replace=False))
        lines.append(" ".join(base))
        for _ in range(3):
            edit = list(base)
            edit[int(rng.integers(90))] = str(rng.choice(words))
            lines.append(" ".join(edit))
    docs = table(spark, list(enumerate(lines)))
    _, _, keys, fps = line_dedup.hash_lines([x.encode() for x in lines])
    assert len(fps) == len(lines)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
        return row[-1]

    parent = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3 and lines[i] != lines[j] and distance(lines[i].split(), lines[j].split()) <= 5:
                a, b = parent[i], parent[j]
                parent = [b if p == a else p for p in parent]
    want = {min(i for i in range(len(lines)) if parent[i] == p) for p in set(parent)}
    got = {r.doc_id for r in line_dedup.without_repeats(docs).collect() if r.text}
    assert got == want and len(want) < len(lines)


def test_long_line_counts_all_its_words():
    text = b" ".join(b"%c%c%c" % (97 + i % 26, 97 + i // 26 % 26, 97 + i // 676) for i in range(3000))
    _, _, _, (fp,) = line_dedup.hash_lines([text])
    _, _, _, parts = line_dedup.hash_lines([b" ".join(text.split()[k : k + 5]) for k in range(0, 3000, 5)])
    assert fp and len(parts) == 600


def test_token_codec_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = rng.choice(np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], np.uint32), n)
        control, data = token_files.encode_ranks(ranks)
        assert len(control) == -(-n // 4)
        assert (token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 300)
    texts = [None, "", "x", PROSE * 5, "é　  日本 <|endoftext|> end\n", "y" * 5000, PROSE]
    docs = table(spark, [*[(7 * i % 11, t) for i, t in enumerate(texts)], (None, "no id"), (7, "")])
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.digest(docs).collect()), key=lambda r: r[2])
    path, start = tokens.vocabulary_path(), 0
    want = []
    for r in docs.collect():
        ids = tokens.brute_ids([r.text], path)[0] + b"\0\0\0\0"
        want.append((r.doc_id is not None, r.doc_id or 0, len(ids) // 4, zlib.crc32(ids)))
    assert Counter((a, b, n, c) for a, b, _, n, c in got) == Counter(want)
    for a, b, s, n, _ in got:
        assert s == start
        start += n
    assert [r[:2] for r in got] == sorted(r[:2] for r in got)
    assert token_files.digest(docs.limit(0)).count() == 0


def test_token_file_detects_a_cut():
    block = token_files.encode_block(0, 0, [1], np.array([2]), np.array([5, 5]), np.array([5, 9]))
    assert [i.tolist() for *_, i in token_files.decode_file(block + b"\n")] == [[5, 5]]
    with pytest.raises(ValueError):
        list(token_files.decode_file(block[:-1] + b"\n"))


def test_toxicity_learns_and_locates(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    bad = ["vilezz", "vilezzen", "grimqx", "grimqxous"]
    rows, labels = [], []
    for i in range(900):
        parts = [" ".join(rng.choice(words, 8)) for _ in range(int(rng.integers(1, 8)))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            k = int(rng.integers(len(parts)))
            parts[k] += " " + str(rng.choice(bad))
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, 1, toxic))
    docs = table(spark, [*rows, (5000, None), (5001, ""), (None, PROSE), (3, rows[3][1])])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 904
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.score < 0.1 for r in got if r.doc_id in (5000, 5001))
    spans = toxicity.offending(docs, model).collect()
    assert spans and np.mean([any(b in r.sentence for b in bad) for r in spans]) > 0.95
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, empty).collect()} == {0}
