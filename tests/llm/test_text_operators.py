"""Operators on single texts and lines: token files, chat, personal data, quality rules, line dedup."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers

from subjex.llm import chat_format, decision_list, deobfuscate, line_dedup, queries, token_shards
from subjex.llm.common import SPACE, shared_path
from subjex.llm.perfect_hash import PerfectHash
from subjex.llm.words import word_hashes
from tests.llm.conftest import SMOKE

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _tokenizer():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def _tokens_by_hand(rows):
    t, out, start = _tokenizer(), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_chunk_encoder_equals_direct_encoding():
    tricky = ["", " ", "  a", "a  b\n c", "x  y  z ", "'s it's  \n\n foo\t bar", " b", "  ", "日本語 テキスト です", "<|endoftext|> x", "é è  ê",
              "x" * 1_200_000 + " y", "🙂 🙃", "a \x1c b", "　 　a b", "a   b  c"]
    rng = random.Random(3)
    added = "<|endoftext|>"
    tricky += [added, f"a {added} b", f"a{added}b {added}{added}", f"{added} ", f" {added}", "<|endoftext|", "<|endo ftext|>", f"x\n{added}\ny", f"w {added} " * 9, "é" * 700_000 + f" z{added} q" + " k" * 400_000]
    tricky += ["".join(rng.choice([added, "a", " ", "é", "\n", "<|", "|>"]) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    tricky += ["".join(rng.choice("ab'é1 \n\t.日  ") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    got = token_shards.ChunkEncoder(VOCABULARY).encode(pa.array(tricky + tricky[::-1]))
    t = _tokenizer()
    for text, ids in zip(tricky + tricky[::-1], got):
        assert t.encode(text, add_special_tokens=False).ids == ids.tolist(), text[:40]


def test_token_files_round_trip(spark, tables):
    rows = [(r.doc_id, r.text) for r in tables(spark, "documents").collect()]
    got = sorted(tuple(r) for r in queries.op1_token_shards(spark, SMOKE).collect())
    assert got == _tokens_by_hand(rows)


def test_token_files_edges_and_single_document(spark, odd, empty):
    path = shared_path(spark, "t")
    token_shards.write(odd, path, VOCABULARY, 2)
    got = token_shards.read(spark, path).collect()
    assert len(got) == odd.count() and sorted(r.start for r in got)[0] == 0
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (1, 2)} == {1: 1, 2: 1}
    ends = {r.start + r.n_tokens for r in got}
    assert {r.start for r in got} - {0} <= ends
    one = token_shards.read(spark, path, only=5).collect()
    assert len(one) == 1 and _tokenizer().decode(np.frombuffer(one[0].ids, "<u4")[:-1].tolist()).endswith("fifth")
    assert token_shards.encode_and_read(empty, VOCABULARY, 2).count() == 0


def test_chat_round_trip_and_loss_mask(spark, tables):
    turns = defaultdict(list)
    for r in tables(spark, "conversations").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = queries.op4_chat_format(spark, SMOKE).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(turns)
    for r in got:
        rows = sorted(turns[r.conv_id])
        learned = "".join(t for _, role, t in rows if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(rows), sha("".join(f"{role}\n{t}\n" for _, role, t in rows)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))


def test_escape_is_reversible():
    rng = random.Random(1)
    bits = [*chat_format.CONTROL, chat_format.ESCAPE, "a", " ", "[", "]", "<", ">", "/s>", "INST]", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        escaped = chat_format.escape(text)
        assert chat_format.unescape(escaped) == text
        assert not any(c in escaped for c in chat_format.CONTROL)


def test_chat_parts_roles_and_edges(spark):
    part = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
    t = lambda s: ("text", s, None, None, None, None, None)
    rows = [(1, 0, "user", "ignored", [t("see [IMAGE:0] "), ("image", None, "a.png", 28, 15, None, None), t(" and "), ("audio", None, "b.wav", None, None, 1.5, None)]),
            (1, 1, "tool]: x", "out", None), (1, 2, None, None, None), (1, 3, "assistant", "</s>ok", [t("</s>ok"), ("document", None, "c.pdf", None, None, None, 2), ("video", None, "d", None, None, None, None)]),
            (2, None, "assistant", None, None), (2, 0, "user", "hi", []), (None, 0, "user", "lost", None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {part}")
    got = {r.conv_id: r for r in chat_format.write_and_read(chat_format.format_conversations(turns)).collect()}
    one = got[1]
    assert [(a.turn, a.kind, a.number, a.ref, a.tokens) for a in one.attachments] == [(0, "image", 0, "a.png", 4), (0, "audio", 1, "b.wav", 38), (3, "document", 2, "c.pdf", 512), (3, "other", 3, "d", 0)]
    assert one.expanded_tokens == 4 + 38 + 512
    parsed = chat_format.parse(one.formatted)
    assert [r for r, _ in parsed] == ["user", "tool]: x", "", "assistant"] and parsed[1][1] == "out"
    assert parsed[0][1] == "see [IMAGE:0] [IMAGE:0] and [AUDIO:1]"
    assert chat_format.parse(got[2].formatted) == [("assistant", ""), ("user", "")] and got[None].formatted.startswith("<s>[INST] lost")
    none = spark.createDataFrame([], turns.schema)
    assert chat_format.digests(chat_format.format_conversations(none)).count() == 0


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _base_by_regex(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(2, m.start(), m.end())] if 13 <= len(d) <= 19 and _luhn(d) else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        out += [(3, m.start(), m.end())] if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15 else []
    return out


def test_base_spans_equal_the_patterns(spark, tables):
    rng = random.Random(1)
    for k in range(20_000):
        t = "".join(rng.choice("a1.@+- 2a0.(9" if k % 3 else "0123456789 -4") for _ in range(rng.randint(0, 30)))
        assert deobfuscate.base_spans(t) == _base_by_regex(t), t
    got = {r.doc_id: r for r in queries.op6_personal_data(spark, SMOKE).collect()}
    for r in tables(spark, "documents").collect():
        base = _base_by_regex(r.text or "")
        g = got[r.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == n for k, *_ in base) for n in range(4)]
        joined = ",".join(f"{deobfuscate.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base))
        assert g.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and g.spans == joined  # no disguises in this table


def test_disguises_map_back_to_source():
    card = "four one one one one one one one one one one one one one one one"
    hits = {"write john dot doe at example dot com now": "john dot doe at example dot com", "j＠example．com": "j＠example．com", "jоhn@exаmple.com": "jоhn@exаmple.com",
            "JOHN (AT) mail [dot] ORG!": "JOHN (AT) mail [dot] ORG", f"pay {card} ok": card, "４１１１ １１１１ １１１１ １１１１": "４１１１ １１１１ １１１１ １１１１",
            "plus one five five five one two three four five six seven": "plus one five five five one two three four five six seven",
            "at one nine two dot one six eight dot one dot one up": "one nine two dot one six eight dot one dot one", "a&#64;b.com": "a&#64;b.com",
            "user@exa​mple.com": "user@exa​mple.com", "x@y.org and 41l1 1111 1111 1111": "41l1 1111 1111 1111"}
    for text, want in hits.items():
        assert [text[a:b] for _, a, b in deobfuscate.added_spans(text, deobfuscate.base_spans(text))] == [want], text
    for clean in ("look at home dot of", "we met at the dot on the map", "null eins zwei", "it is one two three four", "Арбуз на столе в 2020 году", "x² + y³ = 5", "a (b) [c] {d} at e."):
        assert deobfuscate.added_spans(clean, deobfuscate.base_spans(clean)) == [], clean
    assert deobfuscate.redact("mail a@b.co now", [("email", 5, 11)]) == "mail <email> now"


def test_personal_data_edges(spark, odd, empty):
    assert deobfuscate.digest_rows(deobfuscate.find_personal_data(odd)).count() == odd.count()
    assert deobfuscate.find_personal_data(empty).count() == 0


def _base_counts(t):
    words, windows, covered, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), defaultdict(list), set(), set(), 0
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    for at in windows.values():
        for i in at if len(at) > 1 else []:
            covered.update(range(i, i + 5))
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_quality_rules_counts_verdicts_and_edges(spark, tables, odd, empty):
    docs, labels = tables(spark, "documents"), tables(spark, "labels")
    rules = decision_list.learn(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    got = decision_list.judge(docs, rules).collect()
    for r in got:
        assert tuple(r)[1:7] == _base_counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    judged = [r for r in got if r.doc_id in label and not r.base_failed]
    assert sum(r.kept == bool(label[r.doc_id]) for r in judged) >= 0.95 * len(judged)
    assert decision_list.keep_good(docs, rules).count() == sum(r.kept for r in got)
    for r in decision_list.judge(odd, rules).collect():
        if r.doc_id is not None and r.doc_id > 1:
            assert tuple(r)[1:7] == _base_counts({x.doc_id: x.text or "" for x in odd.collect()}[r.doc_id])
    assert decision_list.keep_good(odd, rules).columns == odd.columns
    assert decision_list.learn(docs, labels.limit(0)) == [] and decision_list.judge(empty, []).count() == 0


def test_planted_rule_is_learned(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(("".join(rng.choice("abcdefg") for _ in range(5)) + ("#" if i % 4 == 0 and k % 3 == 0 else "")) for k in range(40))) for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows], "doc_id long, quality int")
    rules = decision_list.learn(docs, labels)
    assert rules and "share >" in rules[0].text
    assert all(r.kept == bool(r.doc_id % 4) for r in decision_list.judge(docs, rules).collect())


def test_perfect_hash_is_minimal_and_rejects_little():
    keys = np.unique(np.random.Generator(np.random.PCG64(1)).integers(0, 2**63, 50_000, dtype=np.uint64))
    mph = PerfectHash.build(keys)
    assert sorted(mph.index(keys).tolist()) == list(range(len(keys))) and not len(mph.rest)
    assert PerfectHash.build(keys[:0]).index(keys[:5]).tolist() == [-1] * 5
    assert len(PerfectHash.build(np.array([7, 7, 9], np.uint64)).rest) == 2


def _lines_by_hand(rows, least=3):
    key = lambda x: x.strip(SPACE).translate(str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower()))
    holders = defaultdict(list)
    for n, (doc_id, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(-1 if doc_id is None else doc_id)
    often = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= least}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in often or often[key(x)] == (-1 if doc_id is None else doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup_in_one_slice_or_many(spark, tables, odd, empty):
    for docs in (tables(spark, "documents"), odd):
        want = _lines_by_hand([(r.doc_id, r.text) for r in docs.collect()])
        assert Counter(map(tuple, line_dedup.drop_repeated_lines(docs).collect())) == want
        assert Counter(map(tuple, line_dedup.drop_repeated_lines(docs, shard_keys=2, slice_mb=0).collect())) == want
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_word_hashes_over_segments():
    texts = ["", "a b", "x" * 1_500_000, "é-ü 1", " ".join(f"w{i}" for i in range(200_000)), ""]
    hashes, at = word_hashes(pa.array(texts))
    want = [re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in want]
    flat = [w for x in want for w in x]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
