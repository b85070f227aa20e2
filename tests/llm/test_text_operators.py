"""BPE, personal data, token counts, secrets and decontamination against plain versions."""

import hashlib
import itertools
import random
import re
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from passagework.llm import blob_ledger, bpe, pii_anchors, spaced_seeds, trie_counts
from passagework.llm.common import Memo, hash_word, word_hashes
from passagework.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Null, empty, blank, long, repeated rows, a null id, and columns named like the operators' own.
ODD = [(1, None), (2, ""), (3, " \n"), (4, "word " * 30000), (5, "same a@b.co"), (5, "same a@b.co"), (None, "no id +1 (389) 555-5010")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 1, "x", "y", 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, found string, blob string, n_tokens int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe_equals_the_library(spark, folder):
    library = Tokenizer.from_file(VOCABULARY)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in bpe.round_trip(docs, VOCABULARY).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_odd_characters_and_any_ids():
    library, codec, pick = Tokenizer.from_file(VOCABULARY), bpe.Codec(bpe.load(VOCABULARY)), random.Random(1)
    letters = "ab 's'll\n\t\x1c\x85\xa0é日0९²\U0001f600́<|endoftext|>"
    low = [chr(k) for k in range(0x370)]
    for k in range(3000):
        t = "".join(pick.choice(letters if k % 2 else low) for _ in range(pick.randint(0, 25))) + "<|endoftext|>" * (k % 7 == 0)
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        some = [pick.randrange(50257) for _ in range(6)]
        assert codec.decode(some) == library.decode(some, skip_special_tokens=False)


def test_bpe_defined_cases(spark, odd):
    rows = bpe.encode(odd, VOCABULARY).collect()
    assert len(rows) == len(ODD) and [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [0, 0]
    back = bpe.decode(bpe.encode(odd, VOCABULARY), VOCABULARY).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in ODD)
    assert bpe.round_trip(empty(spark), VOCABULARY).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda m, d: True,
                "ip": lambda m, d: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda m, d: 13 <= len(d) <= 19 and pii_anchors.luhn(d),
                "phone": lambda m, d: 9 <= len(d) <= 15,
            }[kind](m, d)
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_equals_the_patterns():
    finder, pick = pii_anchors.Finder(), random.Random(3)
    for _ in range(20000):
        letters = pick.choice(["01 -.+()a@", "a@.-b1é", "0123456789 -", "+12 ().-9x", "1.25", "4 1-"])
        t = "".join(pick.choice(letters) for _ in range(pick.randint(0, 45)))
        assert [s for s in finder.spans(t) if s[0] in BASE] == base_spans(t), t


def test_personal_data_added_kinds_and_redaction():
    t = "See https://a.b/c?d=1. I live at 12 Long Oak Street, account no: 12-345678; write to a.b@c.de"
    spans = pii_anchors.Finder().spans(t)
    assert [(k, t[a:b]) for k, a, b in spans] == [
        ("email", "a.b@c.de"), ("url", "https://a.b/c?d=1"), ("address", "12 Long Oak Street"), ("account", "12-345678"),
    ]
    assert pii_anchors.redacted(t, spans) == "See [URL]. I live at [ADDRESS], account no: [ACCOUNT]; write to [EMAIL]"


def test_personal_data_grouped_accounts_and_any_case():
    for t, kind, want in [
        ("IBAN DE89 3704 0044 0532 0130 00 and more", "account", "DE89 3704 0044 0532 0130 00"),
        ("IBAN: GB82 WEST 1234 5698 7654 32 2024", "account", "GB82 WEST 1234 5698 7654 32"),
        ("Account number: 1234 5678 9012, thanks", "account", "1234 5678 9012"),
        ("my account is 12345678 since May", "account", "12345678"),
        ("İ Customer ID 445566", "account", "445566"),
        ("User ID: ab-1234-99", "account", "ab-1234-99"),
        ("account no: 12--345678", "account", "12--345678"),
        ("pAsSpOrT no. is X1234567", "account", "X1234567"),
        ("at 12 Oak St. today", "address", "12 Oak St"),
        ("at 7 Long Elm AVE, today", "address", "7 Long Elm AVE"),
        ("at 221 Hill Rd", "address", "221 Hill Rd"),
    ]:
        spans = pii_anchors.Finder().spans(t)
        assert (kind, want) in [(k, t[a:b]) for k, a, b in spans], t
    for t in ["account is closed", "account for 2024 sales", "12 stones", "the 12 best", "20 hard", "12 months with Dr. Oak", "May 12 St. Ives", "the account was 1234"]:
        assert not pii_anchors.Finder().spans(t), t


def test_personal_data_query(spark, folder, odd):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = sorted((i or -1, sha(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t)))) for i, t in docs.collect())
    got = pii_anchors.digest(pii_anchors.find(docs)).collect()
    assert sorted((r.doc_id or -1, r.base_sha256) for r in got) == want
    assert sum(r.n_email for r in got) == sum(s[0] == "email" for _, t in docs.collect() for s in base_spans(t))
    assert pii_anchors.digest(pii_anchors.find(empty(spark))).count() == 0
    assert pii_anchors.redact(odd).columns == odd.columns


def test_token_counts_equal_the_library(spark, folder, odd):
    pieces = trie_counts.load_pieces(PIECES)
    least = min(pieces.values())
    library = models.Unigram([("<unk>", least), *((f"<0x{b:02X}>", least) for b in range(256)), *pieces.items()], 0, True)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40).select("doc_id", "text").union(odd.select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([(9, "日本 \U0001f600a x́ ''")], docs.schema))
    want = sorted((i or -1, sum(len(library.tokenize("▁" + w)) for w in (t or "").split()), len((t or "").split())) for i, t in docs.collect() if len(t or "") < 1e5)
    got = trie_counts.count_tokens(docs, PIECES).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_words) for r in got if r.n_words < 20000) == want
    assert trie_counts.count_tokens(empty(spark), PIECES).count() == 0


SECRETS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_secrets(text):
    out, least = [], {"access": 20, "hex": 24}
    for n, (kind, pattern) in enumerate(SECRETS.items()):
        for m in pattern.finditer(text or ""):
            if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= least[kind]:
                out.append((m.start(), n, kind, m.end()))
    return sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out)))


def test_secrets_equal_the_patterns_and_the_ledger_grows_by_the_unseen(spark, odd):
    pick = random.Random(2)
    bits = ["password", "PassWd", " ", "=", ":", '"', "'", "token", "api_key", "APIKEY", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123abcdef", "a1", "é", "\U0001f600", "\n", "x."]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randint(0, 30))) for _ in range(500)]
    docs = spark.createDataFrame([*enumerate(texts, 100)], "doc_id long, text string").union(odd.select("doc_id", "text"))
    ledger = blob_ledger.Ledger(spark, scratch_path(spark, "ledger"))
    got = blob_ledger.report(ledger.scan(docs), ledger.findings()).collect()
    assert sorted((r.doc_id or -1, r.base_sha256) for r in got) == sorted((i or -1, base_secrets(t)) for i, t in docs.collect())
    blobs, found = len({t or "" for _, t in docs.collect()}), ledger.findings().count()
    assert ledger.scanned().count() == blobs * len(blob_ledger.RULES)
    ledger.scan(docs)  # nothing is new
    assert (ledger.scanned().count(), ledger.findings().count()) == (blobs * len(blob_ledger.RULES), found)
    newer = (*blob_ledger.RULES[1:], blob_ledger.Rule("assign", 2, r"token=([a-z0-9]+)", 1, 1))
    ledger.scan(docs.limit(3), rules=newer)  # one new pair for each of the blobs
    assert ledger.scanned().count() == blobs * len(blob_ledger.RULES) + docs.limit(3).distinct().count()


def test_secrets_of_an_empty_table(spark):
    ledger = blob_ledger.Ledger(spark, scratch_path(spark, "ledger"))
    assert blob_ledger.report(ledger.scan(empty(spark)), ledger.findings()).count() == 0


def test_masks_meet_every_pattern_of_substitutions():
    for n in range(spaced_seeds.FULL_WORDS, 20):
        for out in itertools.combinations(range(n), n // 5):
            assert any(all(p + o not in out for o in m) for m in spaced_seeds.MASKS for p in range(n - m[-1])), (n, out)


def test_overlaps_equal_brute_force(spark, monkeypatch):
    pick = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [[pick.choice(vocabulary) for _ in range(n)] for n in (3, 5, 7, 9, 10, 12, 13, 15, 20, 40)]
    docs = []
    for _ in range(150):
        words = [pick.choice(vocabulary) for _ in range(pick.randint(0, 40))]
        item = list(pick.choice(items))
        for k in range(len(item)):
            if pick.random() < pick.choice([0, 0.1, 0.25]):
                item[k] = "zz"
        at = pick.randint(0, len(words))
        docs.append(words[:at] + item[pick.randint(0, 2) :] + words[at:])
    want = set()
    for d, k in itertools.product(range(len(docs)), range(len(items))):
        doc, item = docs[d], items[k]
        for offset in range(-len(item) + 1, len(doc)):
            agree = [0 <= q + offset < len(doc) and doc[q + offset] == w for q, w in enumerate(item)]
            near = any(sum(agree[p : p + 13]) >= 11 for p in range(len(agree) - 12))
            if len(item) >= 5 and (5 * sum(agree) >= 4 * len(agree) or near):
                want.add((d, k))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    for hot, group in ((1000, 20_000), (1, 7)):  # at once, and with every seed dealt into parts and many small groups
        monkeypatch.setattr(spaced_seeds, "HOT", hot)
        monkeypatch.setattr(spaced_seeds, "GROUP", group)
        got = spaced_seeds.overlaps(frame, bench.union(bench)).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        kept = {r.doc_id for r in spaced_seeds.clean(frame, bench).collect()}
        assert kept == set(range(len(docs))) - {d for d, _ in want}


def test_overlaps_defined_cases(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too few words")], "item_id long, text string")
    assert spaced_seeds.overlaps(odd, bench).count() == 0
    assert spaced_seeds.clean(odd, bench).count() == len(ODD)
    assert spaced_seeds.overlaps(empty(spark), bench).count() == 0
    assert spaced_seeds.overlaps(odd, bench.limit(0)).count() == 0
    assert len(word_hashes(None, Memo(hash_word))) == 0


def test_overlaps_of_one_long_text_that_repeats_an_item(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, (item + " x ") * 3000, "t"), (2, "two " * 20_000, "t"), (3, (item + " x ") * 3000, "t")], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(7, item, b"0"), (7, item.upper() + "!", b"1"), (8, "two two two two two two", b"2")], "item_id long, text string, digest binary")
    got = sorted(tuple(r) for r in spaced_seeds.overlaps(docs, bench).collect())
    assert got == [(1, 7, 12, 12, 0), (2, 8, 6, 6, 0), (3, 7, 12, 12, 0)]
    assert spaced_seeds.clean(docs, bench).columns == docs.columns


UNITS = ["a://", "http://)", "http://x ", "a@", "a@b.", "+1(", "+1 2", "iban ", "account-", "id: ", "12 long street ", "street", "1.2.3.", "1 2-3", "4111 ", "\u0130@"]


@pytest.mark.parametrize("unit", UNITS)
def test_personal_data_takes_time_in_proportion(unit):
    find = pii_anchors.Finder().spans
    took = []
    for n in (100_000, 400_000):
        text = unit * (n // len(unit))
        start = time.perf_counter()
        find(text)
        took.append(time.perf_counter() - start)
    assert took[1] < 4 and took[1] < 12 * max(took[0], 0.05), (unit, took)


@pytest.mark.parametrize("unit", ["eyJaaaaaaaaaa-", "eyJaaaaaaaaaa.", "ghp_", "xoxa-", "AKIA", "abcdef0", "password ", "token=", "-----BEGIN "])
def test_secrets_take_time_in_proportion(spark, unit):
    took = []
    for n in (50_000, 400_000):
        ledger = blob_ledger.Ledger(spark, scratch_path(spark, "ledger"))
        start = time.perf_counter()
        ledger.scan(spark.createDataFrame([(1, unit * (n // len(unit)))], "doc_id long, text string"))
        took.append(time.perf_counter() - start)
    assert took[1] < took[0] + 12, (unit, took)


def test_a_second_scan_runs_only_the_rules_that_are_new(spark):
    rows = [(1, "password=abcdef1"), (2, "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12), (3, "x-eyJ" + "a" * 30), (4, "password=abcdef1"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ledger = blob_ledger.Ledger(spark, scratch_path(spark, "ledger"))
    ledger.scan(docs, rules=blob_ledger.BASE_RULES)
    paths = ledger.scan(docs)
    pairs = ledger.scanned().collect()
    assert len(pairs) == len({tuple(p) for p in pairs}) == 4 * len(blob_ledger.RULES)
    once = blob_ledger.Ledger(spark, scratch_path(spark, "ledger"))
    want = blob_ledger.report(once.scan(docs), once.findings())
    assert sorted(map(tuple, blob_ledger.report(paths, ledger.findings()).collect())) == sorted(map(tuple, want.collect()))


def test_memos_are_bounded_by_characters(monkeypatch):
    monkeypatch.setattr("passagework.llm.common.MEMO_CHARS", 1000)
    memo = Memo(len)
    for k in range(30):
        assert memo["x" * 90 + str(k)] >= 90
        memo.trim()
        assert memo.chars <= 1100 and len(memo) <= 12
