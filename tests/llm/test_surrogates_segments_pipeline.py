import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import nbsvm, segment, surrogate
from riskloom.llm.queries import QUERIES
from riskloom.sources.tables import read_table
from tests.conftest import SF001
from tests.llm.helpers import DOCS, EDGE, EXTRA, table
from tests.llm.test_dedup_shard_pack_quality import brute_components, brute_simhash, check_packed, reference_tokens  # noqa: F401
from tests.llm.test_secrets_spots_mtree_suffix import brute_base, brute_removed, texts


def run(spark, n, sf):
    name = next(k for k in QUERIES if k.startswith(f"op{n}_"))
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


# ---- surrogates

PRIVATE = [
    (1, "mail anna.b@mail3.example.com or ANNA.B@mail3.example.com, call +1 (268) 555-9530."),
    (2, "again anna.b@mail3.example.com; card 4845168114407329 or 4845-1681-1440-7329, no card 12345"),
    (3, "from 192.168.10.7 and 8.8.4.4 but not 999.1.1.1 or 1.2.3.4.5; ssn 123-45-6789"),
    (4, "Mrs Jane Smith met Mr. Smith, Frau Müller and Herr Карл Иванов; the end"),
    (5, "clean text, 3.14 and 2024-01-02, version 1.2.3 and a@b"),
]


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def shape(s):
    return re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "9", s))


def test_surrogates(spark, tmp_path):
    got = {r["doc_id"]: r for r in run(spark, 4, table(spark, PRIVATE + [(i + 100 if i is not None else None, t) for i, t in EDGE], tmp_path, extra=EXTRA))}
    text = {i: r["text"] for i, r in got.items()}
    assert text[5] == dict(PRIVATE)[5] and text[100] is None and text[107] == dict(EDGE)[7]
    for secret in ("anna.b", "ANNA.B", "(268)", "555-9530", "4845168114407329", "192.168", "8.8.4.4", "123-45", "Jane", "Smith", "Müller", "Карл", "Иванов"):
        assert all(secret not in (t or "") for t in text.values()), secret
    mails = re.findall(r"\S+@\S+(?=[ ,;])", text[1] + text[2])
    assert len({m.lower().split("@")[0] for m in mails}) == 1 and shape(mails[0]) == shape("anna.b@mail3.example.com")
    assert re.search(r"\+1 \([2-9]\d\d\) 555-\d{4}\.", text[1])
    a, b = re.search(r"card (\d{16}) or ([\d-]{19})", text[2]).groups()
    assert a == b.replace("-", "") and a[0] == "4" and luhn(a) % 10 == 0
    assert re.search(r"from \d{3}\.\d{3}\.\d\d\.\d and \d\.\d\.\d\.\d but not 999.1.1.1 or 1.2.3.4.5; ssn \d{3}-\d\d-\d{4}$", text[3])
    m = re.fullmatch(r"Mrs (\w+) (\w+) met Mr. (\w+), Frau (\w+) and Herr (\w+) (\w+); the end", text[4])
    assert m[2] == m[3] != m[4] and m[1] in surrogate.GIVEN["latin", "f"].split() and m[5] in surrogate.GIVEN["cyrillic", "m"].split()
    assert re.fullmatch("[а-яА-Я]+", m[6])
    assert [got[1][f"n_{k}"] for k in surrogate.KINDS] == [2, 0, 0, 1, 0, 0]
    assert run(spark, 4, table(spark, [], tmp_path / "e")) == []


WHOLE = [
    (1, "Mr. John Paul Smith came. Later Smith said that JOHN and Smith's friend, a smith, left; mail Smith@mail1.example.com"),
    (2, "Sra. Maria Lopez Garcia Ruiz, Sra. Lopez, Garcia Ruiz"),
    (3, "Prof. Dr. Ludwig van der Berg and Dr. J. Watson met Berg. Ludwig van der Berg left Mr. Watson's house"),
    (4, "Smith stays, as no title names Smith here"),
    (5, "amex 3782 822463 10005 or 378282246310005, 4222222222222, 6304 0000 0000 0000 000; no card: 3782 822463 10006, 1234567890123"),
    (6, "call 555 123 4567 or 1-555-123-4567, 0171 1234567, (030) 123 45 67, 01 42 68 53 00; on 01.02.2024 at 10 or 2024-01-02"),
]


def test_surrogates_of_whole_entities(spark, tmp_path):
    got = {r["doc_id"]: r for r in run(spark, 4, table(spark, WHOLE, tmp_path))}
    text = {i: r["text"] for i, r in got.items()}
    m = re.fullmatch(r"Mr. (\S+) (\S+) (\S+) came. Later (\S+) said that (\S+) and (\S+)'s friend, a smith, left; mail (\S+)@(\S+)", text[1])
    assert m[3] == m[4] == m[6] and m[5] == m[1].upper() and len({m[1], m[2], m[3], "John", "Paul", "Smith"}) == 6
    m = re.fullmatch(r"Sra. (\S+) (\S+) (\S+) (\S+), Sra. (\S+), (\S+) (\S+)", text[2])
    assert m[2] == m[5] and (m[3], m[4]) == (m[6], m[7])
    assert not {"Maria", "Lopez", "Garcia", "Ruiz"} & set(m.groups()[1:]) and got[2]["n_name"] == 3
    m = re.fullmatch(r"Prof. Dr. (\S+) van der (\S+) and Dr. ([A-Z])\. (\S+) met (\S+)\. (\S+) van der (\S+) left Mr. (\S+)'s house", text[3])
    assert m[2] == m[5] == m[7] and m[1] == m[6] and m[4] == m[8] and not {"Ludwig", "Berg", "Watson"} & set(m.groups())
    assert text[4] == WHOLE[3][1]
    m = re.fullmatch(r"amex (3\d{3} \d{6} \d{5}) or (3\d{14}), (4\d{12}), (6\d{3}(?: \d{4}){3} \d{3}); no card: 3782 822463 10006, 1234567890123", text[5])
    assert m[1].replace(" ", "") == m[2] and all(luhn(x.replace(" ", "")) % 10 == 0 for x in m.groups()) and got[5]["n_card"] == 4
    assert not set(m.groups()) & set(re.split(r"amex | or |, |; ", WHOLE[4][1]))
    m = re.fullmatch(r"call (\d{3} \d{3} \d{4}) or (1-\d{3}-\d{3}-\d{4}), (0\d{3} \d{7}), (\(0\d\d\) \d{3} \d\d \d\d), (0\d(?: \d\d){4}); "
                     r"on 01.02.2024 at 10 or 2024-01-02", text[6])
    assert all(x not in WHOLE[5][1] for x in m.groups()) and got[6]["n_phone"] == 5


def test_surrogates_are_distinct_and_no_entity(spark, tmp_path):
    """Addresses of one-digit octets leave little room: collisions must occur and be resolved."""
    rows = [(i, f"host {a}.{b}.{c}.{d} end") for i, (a, b, c, d) in enumerate(
        (a, b, c, d) for a in range(1, 8) for b in range(1, 8) for c in range(1, 6) for d in range(1, 3))]
    sf = table(spark, rows, tmp_path)
    got = run(spark, 4, sf)
    new = {r["doc_id"]: r["text"].split()[1] for r in got}
    assert len(set(new.values())) == len(rows)
    assert not set(new.values()) & {t.split()[1] for _, t in rows}
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])      # the same by the join that is not broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.doc_id: r.text.split()[1] for r in surrogate.pseudonymised(docs).collect()} == new
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.doc_id: r.text.split()[1] for r in surrogate.pseudonymised(docs, key="other").collect()} != new


def test_surrogates_on_the_documents(spark):
    got = {r["doc_id"]: r["text"] for r in run(spark, 4, SF001)}
    found = 0
    for i, t in texts(SF001):
        private = re.findall(r"\S+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<!\d)\d{16}(?!\d)|(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d.])", t)
        found += len(private)
        assert all(p not in got[i] for p in private)
        if not private:
            assert got[i] == t
    assert found > 5


# ---- segmentations

@pytest.fixture(scope="module")
def vocab():
    return segment.Vocabulary(segment.model_path())


def all_segmentations(vocab, word):
    """Every way through a word's lattice: (ids, weight)."""
    pieces = dict(zip([int(h) for h in vocab.hash], zip(vocab.ids.tolist(), vocab.weight.tolist())))

    def walk(at):
        if at == len(word):
            yield (), 0.0
            return
        for end in range(at + 1, min(len(word), at + vocab.longest) + 1):
            h = int(vocab.prefix_sums(segment.to_chars(word[at:end]))[-1])
            if h in pieces:
                i, w = pieces[h]
            elif end == at + 1:
                b = word[at].encode()
                i, w = None, vocab.byte_weight * len(b)
            else:
                continue
            own = (i,) if i is not None else tuple(int(vocab.byte_id[x]) for x in word[at].encode())
            for ids, rest in walk(end):
                yield own + ids, w + rest
    return list(walk(0))


def test_lattice_is_complete(vocab):
    text = "The cat\n日é 𝒳"
    per_word = [all_segmentations(vocab, w) for w in segment.words_of(text)]
    total = 1
    for p in per_word:
        total *= len(p)
    norm = sum(np.log(sum(np.exp(w) for _, w in p)) for p in per_word)
    lat = segment.Lattice(vocab)
    short = "The a"
    words = [all_segmentations(vocab, w) for w in segment.words_of(short)]
    every = {a[0] + b[0] for a in words[0] for b in words[1]}
    rows = list(segment.segmentations(lat, [5], [short], len(every) + 5))
    assert {tuple(x[2].tolist()) for x in rows} == every and len(rows) == len(every)      # all of them, each once
    assert abs(sum(np.exp(x[3]) for x in rows) - 1) < 1e-4
    assert [x[4] for x in rows] == sorted((x[4] for x in rows), reverse=True)
    assert {x[5] for x in rows} == {1.0}
    for _, _, ids, lp, _, _ in segment.segmentations(lat, [1], [text], 3):
        assert segment.decode(vocab, ids) == text.encode()
        want = [next(w for i, w in p if i == own) for p, own in zip(per_word, split_ids(vocab, ids, per_word))]
        assert abs(lp - (sum(want) - norm)) < 1e-3


def split_ids(vocab, ids, per_word):
    out, at, ids = [], 0, tuple(int(i) for i in ids)
    for p in per_word:
        own = next(i for i, _ in sorted(p, key=lambda x: -len(x[0])) if ids[at:at + len(i)] == i)
        out.append(own)
        at += len(own)
    assert at == len(ids)
    return out


def test_draws_without_replacement(vocab):
    """First draws follow the lattice's distribution; pairs that of draws without
    replacement; inclusion scores weigh to unbiased counts."""
    lat = segment.Lattice(vocab)
    word = "The"
    every = {ids: w for ids, w in all_segmentations(vocab, segment.words_of(word)[0])}
    z = np.log(sum(np.exp(w) for w in every.values()))
    p = {ids: float(np.exp(w - z)) for ids, w in every.items()}
    n = 6000
    first, pairs, weight = Counter(), Counter(), defaultdict(float)
    rows = list(segment.segmentations(lat, list(range(n)), [word] * n, 2))
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for two in by.values():
        a, b = (tuple(r[2].tolist()) for r in two)
        assert a != b
        first[a] += 1
        pairs[a, b] += 1
        for r in two:
            weight[tuple(r[2].tolist())] += np.exp(r[3]) / r[5] / n
    top = sorted(p, key=p.get)[-3:]
    for a in top:
        assert abs(first[a] / n - p[a]) < 5 * np.sqrt(p[a] / n) + 1e-3
        assert abs(weight[a] - p[a]) < 0.15 * p[a] + 0.01
        for b in top:
            if a != b:
                want = p[a] * p[b] / (1 - p[a])
                assert abs(pairs[a, b] / n - want) < 5 * np.sqrt(want / n) + 2e-3


def test_segmentation_query(spark, tmp_path, vocab):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=segment.model_path())
    rows = list(dict(EDGE).items()) + [(70, "double  space and\ttab\n" * 3), (71, "x" * 5000)]
    got = run(spark, 5, table(spark, rows, tmp_path, extra=EXTRA))
    text = {i: t or "" for i, t in rows}
    seen = defaultdict(list)
    for r in got:
        assert r["decoded_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        assert 0 < r["inclusion"] <= 1 or r["log_prob"] < -600
        seen[r["doc_id"]].append(r)
    assert [r["n_pieces"] for r in seen[1]] == [0] and len(seen) == len(rows)
    assert all(len({r["ids_crc32"] for r in v}) == len(v) for v in seen.values())
    assert all(sorted(r["rank"] for r in v) == list(range(1, len(v) + 1)) for v in seen.values())
    assert run(spark, 5, table(spark, [], tmp_path / "e")) == []
    # a row's samples do not depend on its neighbours, and the library decodes them to the text
    lat = segment.Lattice(vocab)
    for i, t in rows[3:8] + [(70, text[70])]:
        alone = list(segment.segmentations(lat, [i], [t or ""], 2))
        assert [zlib.crc32(x[2].astype("<u4").tobytes()) for x in alone] == [r["ids_crc32"] for r in sorted(seen[i], key=lambda r: r["rank"])]
        assert all(sp.decode(x[2].tolist()) == (t or "") for x in alone)


def raw_pieces():
    """Every piece of the vocabulary as the library lists it: string -> (id, weight); and the weight of a byte."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=segment.model_path())
    score = [sp.get_score(i) for i in range(sp.get_piece_size())]
    worst = 1 + max(-x for x in score if x > -1e8)
    return {sp.id_to_piece(i): (i, -np.log(2 + min(-score[i], worst))) for i in range(len(score))
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}, -np.log(2 + worst)


def raw_ways(text, pieces, byte):
    """Log mass of all segmentations of the raw text, and their pieces at every place."""
    text = "▁" + text.replace(" ", "▁")
    steps = []
    for at in range(len(text)):
        own = [(at + n, *pieces[text[at:at + n]]) for n in range(1, 17) if at + n <= len(text) and text[at:at + n] in pieces]
        if text[at] not in pieces:
            own.append((at + 1, None, byte * len(text[at].encode())))
        steps.append(own)
    mass = [0.0] * (len(text) + 1)
    for at in range(len(text) - 1, -1, -1):
        mass[at] = np.logaddexp.reduce([w + mass[end] for end, _, w in steps[at]])
    return mass[0], steps


def test_lattice_of_the_raw_text(vocab):
    """No border inside a text takes a piece away: runs of spaces, long words, text without spaces."""
    pieces, byte = raw_pieces()
    by_id = {i: w for i, w in pieces.values()}
    lat = segment.Lattice(vocab)
    z, steps = raw_ways("a    b ", pieces, byte)

    def every(at):
        return [()] if at == len(steps) else [(i, *rest) for end, i, _ in steps[at] for rest in every(end)]
    want = set(every(0))
    rows = list(segment.segmentations(lat, [1], ["a    b "], len(want) + 5))
    assert {tuple(r[2].tolist()) for r in rows} == want and len(rows) == len(want)
    assert {pieces["▁▁"][0], pieces["▁▁▁▁"][0]} <= {i for ids in want for i in ids}
    rng = np.random.default_rng(3)
    base64 = "".join(rng.choice(list("ABCDEFabcdefxyz0189+/"), 700))
    for i, text in enumerate(["x" * 5000, base64, "https://www.example.com/" + "international/" * 40, "日本語の文章です。" * 60,
                              "word\nother\n" * 50, " " * 300 + "end", "x" * 62 + "the" + "y" * 62, "one two"]):
        z, _ = raw_ways(text, pieces, byte)
        for _, _, ids, log_prob, _, _ in segment.segmentations(lat, [i], [text], 2):
            assert segment.decode(vocab, ids) == text.encode()
            assert abs(log_prob - (sum(by_id.get(x, byte) for x in ids.tolist()) - z)) < 2e-3 * (1 + len(ids) ** 0.5)


def test_long_words_are_taken_apart_across_blocks(vocab, monkeypatch):
    text = "▁" + "international/日本.com\n" * 40
    want = segment.parts_of(vocab, [text])
    monkeypatch.setattr(segment, "BLOCK", 7)
    assert segment.parts_of(vocab, [text, text[3:]])[text] == want[text] and "".join(want[text]) == text and len(want[text]) > 80


# ---- pipeline

def trimmed(text, keep_mask):
    """Text without the bytes that ``keep_mask`` drops, characters kept whole."""
    data, out, at = text.encode(), [], 0
    for ch in text:
        n = len(ch.encode())
        if keep_mask[at:at + n].any():
            out.append(ch)
        at += n
    assert at == len(data)
    return "".join(out)


def removed_mask(rows, depth=200):
    data = [t.encode() for _, t in rows]
    first, masks = set(), []
    for d in data:
        keep = np.ones(len(d), bool)
        own = []
        for i in range(len(d) - depth + 1):
            w = d[i:i + depth]
            if w in first:
                keep[i:i + depth] = False
            first.add(w)
        masks.append(keep)
        del own
    return masks


def test_pipeline_against_brute_force(spark, reference_tokens, tmp_path):  # noqa: F811
    import corpus_pipeline as P
    given = texts(SF001)
    given.append((5000, " ".join(dict(given)[1].split()[::-1]) + ' and password = "abcdefgh12345"'))
    sf = table(spark, given, tmp_path)
    read_table(spark, SF001, "labels").write.parquet(f"{sf}/labels.parquet")
    docs = read_table(spark, sf, "documents")
    cols = docs.columns
    stage = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeats", "secrets", "packing"]
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    one = stage["quality"](spark, docs, sf)
    model = nbsvm.fit(docs, read_table(spark, sf, "labels"))
    words = nbsvm.Words()
    want = [(i, t) for i, t in given
            if 1 / (1 + np.exp(-(model[1] * nbsvm.margin(model[0], nbsvm.features(t, words)) + model[2]))) >= 0.3]
    assert one.columns == cols and rows(one) == want

    one = one.cache()
    two = stage["near_duplicates"](spark, one, sf)
    comp = brute_components({i: brute_simhash(t) for i, t in want})
    want = [(i, t) for i, t in want if comp[i] == i]
    assert two.columns == cols and rows(two) == want

    three = stage["repeats"](spark, two, sf)
    want = [(i, trimmed(t, m)) for (i, t), m in zip(want, removed_mask(want)) if m.any() or not t]
    assert three.columns == cols and rows(three) == want
    assert all(r.n_chars == len(r.text) for r in three.collect())

    four = stage["secrets"](spark, three, sf)
    assert four.columns == cols
    got = dict(rows(four))
    for i, t in want:
        spans, out, at = brute_base(t), [], 0
        ends = sorted((b - len(re.match(r".*?[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", t[a:b], re.S)[1]) if k == 0 else a, b) for a, k, b in spans)
        for a, b in ends:
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        assert got[i] == "".join([*out, t[at:]])
    assert sum("[SECRET]" in t for t in got.values()) > 0

    five = P.run(spark, sf)
    check_packed([r.asDict() for r in five.collect()], list(got.items()), reference_tokens)


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline as P
    lab = "doc_id bigint, quality int, toxic int"
    sf = table(spark, EDGE, tmp_path, extra=EXTRA)
    table(spark, [(4, 1, 0), (6, 1, 0)], tmp_path, "labels", lab)
    docs = read_table(spark, sf, "documents")
    assert {f.name for f in DOCS} <= set(docs.columns)
    for name, f in P.STAGES[:-1]:
        assert f(spark, docs, sf).columns == docs.columns
    out = P.run(spark, sf).collect()
    assert {r.doc_id for r in out} >= {0, 3, 4, 7, None}
    table(spark, [], tmp_path)
    assert P.run(spark, sf).collect() == []
