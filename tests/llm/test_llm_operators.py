"""The ten operators against brute force, on small tables with nulls, empty texts, ties, repeats and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import bfd_packing, byte_cnn, common, components, license_scan, line_quality, minhash_dedup, piece_dropout, secret_scan, sos_packing, substring_dedup, telephony, tokens
from marginalia.llm.common import pack_ints, unpack_ints

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, places string"
ODD = [None, "", " \n\t ", "word", "a b", "Ünïcödé   x", "▁ \x00 \x1c", "z" * 5000, "the the the the the the", "a\n\nb\n", "<|endoftext|> <s> <0x0A>"]


def table(spark, texts, start=0, source="s"):
    """documents with columns whose names clash with the operators' own."""
    rows = [(start + i, t, "en", source if isinstance(source, str) else source[i], len(t or ""), i, "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), vocabulary)}" for _ in range(n))


def test_codec():
    for v in ([], [5], [-3, 7, 7, 2**40, -(2**62)]):
        assert unpack_ints(pack_ints(np.array(v, np.int64))).tolist() == v


# ---- 1 ----


def ulaw(code):
    code = ~code & 0xFF
    t = (((code & 15) << 3) + 0x84) << ((code >> 4) & 7)
    return 0x84 - t if code & 0x80 else t - 0x84


def alaw(code):
    code ^= 0x55
    t, seg = (code & 15) << 4, (code >> 4) & 7
    t = t + 8 if seg == 0 else (t + 0x108) << (seg - 1)
    return t if code & 0x80 else -t


def adpcm(block):
    steps, moves = telephony.step_tables()
    value, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(steps[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(moves[code])))
            out.append(value)
    return out


def test_telephony_tables():
    assert telephony.ulaw_table().tolist() == [ulaw(c) for c in range(256)]
    assert telephony.alaw_table().tolist() == [alaw(c) for c in range(256)]


def test_telephony(spark):
    df = table(spark, ODD)
    got = {r.doc_id: r for r in telephony.telephony(df).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert telephony.samples(bytes(r.media)) == (7, 8000, payload)
        want = [x for k in range(0, len(payload), 64) for x in adpcm(payload[k : k + 64])]
        assert np.frombuffer(bytes(r.adpcm_pcm), "<i2").tolist() == want
        kind, rate, pcm = telephony.samples(bytes(r.pcm))
        assert (kind, rate) == (1, 16000) and np.frombuffer(pcm, "<i2")[::2].tolist() == [ulaw(c) for c in payload]
    with pytest.raises(ValueError, match="WAVE"):
        telephony.samples(b"RIFFxxxx")
    assert telephony.telephony(table(spark, [])).count() == 0


# ---- 2 and 5 ----


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary()).encode(text or "", add_special_tokens=False).ids


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    letters = "abzAZ09.,'!-é ÉßÿÖ×÷Ñ\n\t́Jǰ中<|> \u0085"
    texts = [*[t for t in ODD if t], *["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)], "don't we'll I'M J̌ É́"]
    ids, ends = tokens.WordTokenizer(tokens.default_vocabulary()).encode(pa.array(texts), 2)
    library, begin = Tokenizer.from_file(tokens.default_vocabulary()), 0
    for t, e in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:e].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], repr(t)
        begin = e


def test_segment_tree_is_best_fit():
    rng = random.Random(1)
    for _ in range(30):
        window = rng.choice([7, 16, 100])
        sizes = [rng.randint(1, window) for _ in range(rng.randrange(1, 80))]
        rows, room, brute = bfd_packing.best_fit(sizes, window), [], []
        for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fit = min([r for r in room if r >= sizes[i]], default=None)
            if fit is None:
                room.append(window - sizes[i])
            else:
                room[room.index(fit)] -= sizes[i]
            brute.append(i)
        assert sorted(i for r in rows for i in r) == sorted(brute) and len(rows) == len(room)
        assert sorted(window - sum(sizes[i] for i in r) for r in rows) == sorted(room)


def test_bfd_pack_is_lossless(spark):
    rng = random.Random(2)
    texts = [*ODD, *[prose(rng, rng.choice([3, 40, 900])) for _ in range(40)]]
    ids, again = defaultdict(dict), 0
    for r in bfd_packing.bfd_pack(table(spark, texts), window=256).collect():
        row, place = np.frombuffer(bytes(r.ids), "<u2"), np.frombuffer(bytes(r.position_ids), "<u4")
        assert len(row) == 256 and r.cu_seqlens[-1] == r.n_tokens and r.cu_seqlens[0] == 0 and not row[r.n_tokens :].any()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            ids[d][s] = row[a:b].tolist()
            assert place[a:b].tolist() == list(range(s, s + b - a))
            again += 1
    for i, t in enumerate(texts):
        assert [x for _, p in sorted(ids[i].items()) for x in p] == [*reference_ids(t), 2]


def test_bfd_pack_in_any_order(spark):
    """A partition's matrix rows are the same in whatever order its documents come."""
    rng = random.Random(3)
    rows = [(i // 2 if i % 9 else None, prose(rng, rng.choice([3, 40, 300])) if i % 7 else None) for i in range(60)]
    found = []
    for _ in range(2):
        rng.shuffle(rows)
        packed = bfd_packing.bfd_pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), window=128, buffer_tokens=1000)
        found.append([(r.lead_doc_id, r.lead_start, bytes(r.ids), r.cu_seqlens, r.doc_ids) for r in packed.collect()])
    assert found[0] == found[1] and len(found[0]) > 9


def brute_sum_of_squares(sizes, window):
    level, out = [], []
    for s in sizes:
        count = Counter(x for x in level if x < window)
        best = None
        for k in [None, *sorted(set(count))]:
            at = 0 if k is None else k
            if at + s > window:
                continue
            new = Counter(count)
            if k is not None:
                new[k] -= 1
            if at + s < window:
                new[at + s] += 1
            total = (sum(v * v for v in new.values()), -at)
            best = min(best or (total, k), (total, k), key=lambda x: x[0])
        out.append(best[1] or 0)
        if best[1] is None:
            level.append(s)
        else:
            level[level.index(best[1])] += s
    return out


def test_sum_of_squares():
    rng = random.Random(4)
    for window in (8, 30):
        sizes = [rng.randint(1, window) for _ in range(200)]
        packer = sos_packing.SumOfSquares(window)
        assert [packer.place(s)[1] for s in sizes] == brute_sum_of_squares(sizes, window)


def check_packing(rows, texts, window):
    docs, fills = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        fills[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids, at = [*reference_ids(t), 2], 0
        for r in sorted(docs[i], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for f in fills.values():
        at = 0
        for offset, length in sorted(f):
            assert offset == at
            at += length
        assert at <= window
    return fills


def test_sos_pack(spark):
    rng = random.Random(3)
    texts = [*ODD, *[prose(rng, rng.choice([3, 90, 700])) for _ in range(200)]]
    df = table(spark, texts)
    fills = check_packing(sos_packing.sos_pack(df, window=512).collect(), dict(enumerate(texts)), 512)
    padded = sum(512 - sum(n for _, n in f) for f in fills.values())
    assert padded < 0.05 * 512 * len(fills)
    one, two = (sorted(map(tuple, sos_packing.sos_pack(d, window=512, shard_docs=50).collect())) for d in (df, df.repartition(7)))
    assert one == two
    assert sos_packing.sos_pack(table(spark, [])).count() == 0


# ---- 3 ----


def brute_lines(rows):
    norm = lambda x: re.sub(r"[ \t-\r]+", " ", x.strip(" \t\n\x0b\f\r")).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held, kept = defaultdict(set), {}
    for i, t, s in rows:
        lines = [x for x in (t or "").split("\n") if re.search(r"[^ \t-\r]", x)]
        said = frozenset(map(norm, lines))
        for x in said:
            held[s, x].add(said)
        kept[i] = lines
    out = {}
    for i, t, s in rows:
        w = re.findall(r"[^ \t-\r]+", t or "")
        threes = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if threes[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        gone = sum(len(re.findall(r"[^ \t-\r]+", x)) for x in kept[i] if len(held[s, norm(x)]) > 20)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(kept[i]) - len(set(kept[i])), len(covered), failed, not failed and 100 * (len(w) - gone) >= 30 * len(w), gone)
    return out


def test_line_quality(spark):
    rng = random.Random(6)
    texts = [*ODD]
    for k in range(60):
        own = "\n".join(prose(rng, 30) for _ in range(3))
        texts.append(own + "\nShared  Footer line here\n" + prose(rng, 4 + k % 9))
    copy = "\n".join(prose(rng, 30) for _ in range(4))
    texts += [copy] * 30 + ["shared footer LINE here\n" * 20 + prose(rng, 20)]
    source = [("a" if i % 3 else "b") if i > 5 else None for i in range(len(texts))]
    source[-31:] = ["a"] * 31
    df = table(spark, texts, source=source)
    want = brute_lines([(i, t, s or "") for i, (t, s) in enumerate(zip(texts, source))])
    got = {r[0]: tuple(r)[1:9] for r in line_quality.line_quality(df).collect()}
    assert got == want
    assert any(v[7] for v in want.values()) and all(want[i][6] for i in range(len(texts) - 31, len(texts) - 1))
    left = {r.doc_id: r for r in line_quality.without_boilerplate(df).collect()}
    assert set(left) == {i for i, v in want.items() if v[6]} and list(left[20].asDict()) == df.columns
    hit = next(i for i, v in want.items() if v[6] and v[7])
    assert "Footer" not in left[hit].text and left[hit].n_chars == len(left[hit].text)
    assert line_quality.line_quality(table(spark, [])).count() == 0


def test_boilerplate_of_repeated_ids(spark):
    own = ["\n".join(" ".join(f"u{k}.{j}.{i}" for i in range(30)) for j in range(3)) for k in range(30)]
    rows = [(k, t + "\nfooter of all") for k, t in enumerate(own)]
    rows += [rows[3], (3, own[7] + "\nanother"), (None, own[8] + "\nfooter of all"), (None, own[8] + "\nfooter of all"), (4, "short")]
    columns = "doc_id long, text string, source string, bad_ string, doc_id_ long, of_ int, said_ int, said int"
    df = spark.createDataFrame([(i, t, "s", "b", 1, 2, 3, 4) for i, t in rows], columns)
    got = sorted((str(r.doc_id), r.text) for r in line_quality.without_boilerplate(df).collect())
    want = [(k, t) for k, t in enumerate(own)] + [(3, own[3]), (3, own[7] + "\nanother")] + [(None, own[8] + "\nfooter of all")] * 2
    assert got == sorted((str(i), t) for i, t in want)
    assert line_quality.without_boilerplate(df).columns == df.columns and line_quality.without_boilerplate(df.limit(0)).count() == 0


def test_boilerplate_of_several_lines(spark):
    rng = random.Random(13)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    footer = "\n".join(f"footer line {k} of five" for k in range(5))
    block = "\n".join(f"notice line {k} of five" for k in range(5))
    texts = [f"{own(60)}\n{block}\n{own(60)}\n{footer}" for _ in range(30)]
    texts += ["\n".join(own(20) for _ in range(4))] * 30 + [f"{own(4)}\n{footer}\n" + f"{block}\n" * 3]
    got = {r.doc_id: r for r in line_quality.line_quality(table(spark, texts)).collect()}
    assert all(got[i].n_removed_words == 50 and got[i].kept for i in range(30))
    assert all(got[i].n_removed_words == 0 for i in range(30, 60))
    assert got[60].n_removed_words == 100 and not got[60].kept
    left = {r.doc_id: r.text for r in line_quality.without_boilerplate(table(spark, texts)).collect()}
    assert all(left[i] == "\n".join(texts[i].split("\n")[k] for k in (0, 6)) for i in range(30))


# ---- 4 ----


def plain_words(text):
    """Runs of letters and digits, character by character."""
    out, run = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def plain_units(text):
    """(unit, first line, lines, words) of lines, paragraphs of two lines or more, and texts of two paragraphs or more."""
    lines = [plain_words(x) for x in (text or "").split("\n")]
    units, runs, run = [("line", i, 1, w) for i, w in enumerate(lines)], [], []
    for i, w in enumerate([*lines, []]):
        if w:
            run.append(i)
        elif run:
            runs.append(run)
            run = []
    units += [("paragraph", r[0], len(r), [x for i in r for x in lines[i]]) for r in runs if len(r) > 1]
    return units + [("document", 0, len(lines), [x for w in lines for x in w])] * (len(runs) > 1)


def plain_pairs(words):
    return {f"{x} {y}" for x, y in zip(words, words[1:])}


def plain_scan(text, templates, threshold):
    """``templates`` are names with pairs; all are compared with every unit."""
    out = []
    for unit, at, n, words in plain_units(text):
        a = plain_pairs(words)
        found = sorted((-2 * len(a & b) / (len(a) + len(b)), name) for name, b in templates if a and b)
        if found and -found[0][0] >= threshold / 100:
            out.append((found[0][1], unit, at, n, round(-found[0][0], 9)))
    return out


def changed(rng, text, share):
    """``text`` with a share of its words replaced."""
    return "\n".join(" ".join("zebra" if rng.random() < share else w for w in line.split(" ")) for line in text.split("\n"))


@pytest.mark.parametrize("threshold", [60, 80])
def test_license_scan(spark, threshold):
    known, rng = license_scan.library(), random.Random(4)
    whole = {name: many[-1] for name, many in known.items() if len(many[-1]) > 700}
    mit = license_scan.TEMPLATES["MIT"][1]
    texts = [
        *ODD, "x\nReleased under the MIT License.\ny", "licensed under the apache license version 2 0", mit.replace("software ", "program ", 1),
        "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60)), "All rights reserved.\n\nAll rights reserved.", "all rights " * 4000, mit + " " + "the software " * 3000,
    ]
    n = len(texts)
    texts += [changed(rng, whole[name], share) for name in sorted(whole) for share in (0.0, 0.04, 0.12)]
    texts += [prose(rng, 300) + "\n\n" + whole["BSD-2-Clause"], whole["MIT"] + "\n\n" + prose(rng, 40), whole["MIT"].replace("\n", "\r\n"), whole["ISC"].upper()]
    got = {r.doc_id: r for r in license_scan.license_scan(table(spark, texts), threshold=threshold).collect()}
    templates = [(name, plain_pairs(plain_words(t))) for name, many in known.items() for t in many]
    for i, t in enumerate(texts):
        want = plain_scan(t, templates, threshold)
        assert [(m.license, m.unit, m.line, m.lines, round(m.dice, 9)) for m in got[i].matches] == want
        assert (got[i].n_matches, got[i].licenses) == (len(want), ",".join(sorted({w[0] for w in want})))
        assert round(got[i].best_dice, 9) == max((w[4] for w in want), default=0)
    if threshold == 80:
        assert [got[len(ODD) + k].licenses for k in range(5)] == ["MIT", "Apache-2.0", "MIT", "MIT", "All-rights-reserved"]
        for k, name in enumerate(sorted(whole)):  # whole licences, as they are and with four words in a hundred changed
            assert [m.license for m in got[n + 3 * k].matches if m.unit == "document"] == [name]
            assert [m.license for m in got[n + 3 * k + 1].matches if m.unit == "document"] == [name]


def test_templates_of_the_caller(spark):
    got = license_scan.license_scan(table(spark, ["one two three four", "nothing here", None]), {"own": ("One, two; three four!",), "none": ("word", "")}, 100)
    assert [(r.doc_id, r.licenses, r.best_dice) for r in got.sort("doc_id").collect()] == [(0, "own", 1.0), (1, "", 0.0), (2, "", 0.0)]
    assert license_scan.license_scan(table(spark, [])).count() == 0


# ---- 6 ----


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGHIJ234567"
    live, shared = "f3a9c1d7b2e84f60a1c5d9e7", "0641917ea4e9feb9cda83477b57ac2654884f485"
    texts = [*ODD, f"é password = {live} end", f'token="{shared}"', f"x token: {shared}", f"SECRET={shared} {key}", "api_key=short1 token=abc", f"url https://me:hunter22pass@h.x {live}"]
    source = [f"s{i % 5}" for i in range(len(texts))]
    got = {r.doc_id: r for r in secret_scan.secrets(table(spark, texts, source=source)).select("*", secret_scan.span_text().alias("spans")).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        a = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 6]
        b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if m.end() - m.start() >= 20]
        c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if m.end() - m.start() >= 24]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(a + b + c))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (len(a), len(b), len(c))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(got[i].spans.split(","))
    n = len(ODD)
    assert {j.verdict for j in got[n + 1].judged} == {"example"} and {j.owners for j in got[n + 1].judged} == {3}
    assert {j.verdict for j in got[n].judged} == {"live"}
    clean = {r.doc_id: r for r in secret_scan.redact(table(spark, texts, source=source)).collect()}
    assert clean[n].text == "é [secret] end" and clean[n].n_chars == len(clean[n].text)
    assert clean[n + 1].text == texts[n + 1] and clean[0].text is None and len(clean) == len(texts)
    assert clean[n + 3].text == f"SECRET={shared} [secret]"


def test_verdicts_by_ownership(spark):
    rng = random.Random(62)
    values = ["".join(rng.choices("abcdef0123456789", k=24)) for _ in range(25)] + ["a" * 24]
    rows = [(k, rng.choice(values), f"o{min(int(rng.paretovariate(1.2)), 5)}", f"r{rng.randrange(6)}") for k in range(160)]
    df = spark.createDataFrame([(i, f"x token={v} y", o, r) for i, v, o, r in rows], "doc_id long, text string, source string, lang string")
    owners, repositories = defaultdict(set), defaultdict(set)
    for _, v, o, r in rows:
        owners[v].add(o)
        repositories[v].add((o, r))
    seen = set()
    by_id = {i: v for i, v, _, _ in rows}
    for r in secret_scan.secrets(df).collect():
        v = by_id[r.doc_id]
        n, m = len(owners[v]), len(repositories[v])
        verdict = "example" if n >= 3 or (n == 2 and m >= 8) else "weak" if v == "a" * 24 else "live"
        assert {(j.owners, j.repositories, j.verdict) for j in r.judged} == {(n, m, verdict)}
        seen.add((n > 1, verdict))
    assert {(False, "live"), (True, "example"), (True, "live")} <= seen
    assert secret_scan.secrets(df.limit(0)).count() == 0 and secret_scan.redact(df.limit(0)).count() == 0


def test_redact_repeated_ids(spark):
    live = "password=f3a9c1d7b2e84f60a1c5d9e7"
    rows = [(1, f"a {live} b"), (1, "no secret here, just a long text"), (1, f"a {live} b"), (None, f"c {live}"), (None, None), (2, f"{live} d {live}")]
    df = spark.createDataFrame([(i, t, "s", "en", 0, "q", "v", "w") for i, t in rows], "doc_id long, text string, source string, lang string, row_ int, live_ string, cut_ string, of_ string")
    got = sorted((str(r.doc_id), str(r.text)) for r in secret_scan.redact(df).collect())
    assert got == sorted([("1", "a [secret] b"), ("1", rows[1][1]), ("1", "a [secret] b"), ("None", "c [secret]"), ("None", "None"), ("2", "[secret] d [secret]")])
    assert {tuple(r)[4:] for r in secret_scan.redact(df).collect()} == {(0, "q", "v", "w")}


def test_long_url_passwords_and_keys_with_headers():
    long = "eyJ0" + "aB3dE5gH" * 40
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n"
    body = "MIIEowIBAAKCAQEA7b+/x9\nq8Zr4Tt1==\n"
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{head}{body}-----END"
    for text, kind, value in (
        (f"x https://{'u' * 300}:{long}@h.x y", 3, long), ("redis://:hunter22pass@h:6379", 3, "hunter22pass"), (f"a {key} RSA PRIVATE KEY-----", 4, key),
        (key.replace("Proc", "Comment: two words\nProc"), 4, None), (" ".join(key.split()), 4, None), (key.replace(head, ""), 4, None),
    ):
        found = [x for x in secret_scan.candidates(text) if x[0] == kind]
        assert len(found) == 1 and (value or text) == found[0][3]
    assert not [x for x in secret_scan.candidates("-----BEGIN PRIVATE KEY----------END and -----BEGIN PRIVATE KEY----- is prose, -----END") if x[0] == 4]


# ---- 7 ----


def brute_repeats(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone[k : k + window] = [True] * window
            seen.add(x)
        kept = b" ".join(a for a, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_cover_is_a_difference_cover():
    p, c = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))


def test_substring_dedup(spark):
    rng = random.Random(7)
    passage = [prose(rng, n, 10**6) for n in (20, 21, 19, 60)]
    texts = [*ODD]
    for k in range(120):
        parts = [prose(rng, rng.randrange(0, 60), 10**6) for _ in range(3)]
        parts.insert(rng.randrange(4), passage[k % 4])
        texts.append((" " if k % 2 else "\n").join(parts))
    texts += [texts[20]] * 40 + [" ".join(["loop"] * 80), f"{passage[3]} {passage[3]}"]
    order = rng.sample(range(len(texts)), len(texts))
    rows = [(o, t) for o, t in zip(order, texts)]
    df = spark.createDataFrame([(o, t, "en", "s", len(t or ""), 1, "p") for o, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)
    left = {r.doc_id: r for r in substring_dedup.without_repeats(df).collect()}
    assert len(left) == len(texts) and left[order[0]].text is None
    assert all(left[o].text == t for o, t in rows if got[o][1] == 0)
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0


def test_substrings_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ANSWERED", 5)
    rng = random.Random(71)
    a, b = prose(rng, 60, 10**6), prose(rng, 30, 10**6)
    rows = [(3, a), (3, a), (3, b + " " + a), (8, b), (1, "x y"), (None, a), (None, a), (None, None), (2, None)]
    columns = "doc_id long, text string, doc_id_ long, kept_text_ string, kept string, rest string, kind int, places string"
    df = spark.createDataFrame([(i, t, 1, "k", "q", "r", 2, "p") for i, t in rows], columns)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df.repartition(3)).collect())
    first = [("3", 60, 0)] * 2 + [("3", 90, 60)], [("3", 60, 60)] * 2 + [("3", 90, 0)]  # by the order of hashes
    rest = [("8", 30, 30), ("1", 2, 0), ("None", 60, 0), ("None", 60, 0), ("None", 0, 0), ("2", 0, 0)]
    assert got in [sorted([*x, *rest]) for x in first]
    left = substring_dedup.without_repeats(df)
    assert left.columns == df.columns and left.count() == 9 and {(r.doc_id_, r.kept_text_, r.kept, r.rest, r.kind) for r in left.collect()} == {(1, "k", "q", "r", 2)}


# ---- 8 ----


def test_pieces_equal_the_library_and_decode(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_dropout.default_model())
    rng = random.Random(8)
    texts = [*[t for t in ODD if t is None or "▁" not in t], *[prose(rng, 30) + rng.choice(["", "\n", "  x", "é中😀"]) for _ in range(100)]]
    got = piece_dropout.piece_dropout(table(spark, texts), dropout=0.0).collect()
    assert all(r.lossless for r in got)
    assert {r.doc_id: r.ids for r in got} == {i: sp.encode(t or "") for i, t in enumerate(texts)}
    some = {r.doc_id: r for r in piece_dropout.piece_dropout(table(spark, [*texts, "▁ a ▁"]), dropout=0.3).collect()}
    assert all(r.lossless for r in some.values())
    assert sum(r.n_pieces for r in some.values()) > 1.1 * sum(r.n_pieces for r in got)
    again = {r.doc_id: r.ids_sha256 for r in piece_dropout.piece_dropout(table(spark, texts).repartition(5), dropout=0.3).collect()}
    assert all(some[i].ids_sha256 == x for i, x in again.items())
    other = {r.doc_id: r.ids_sha256 for r in piece_dropout.piece_dropout(table(spark, texts), dropout=0.3, seed=1).collect()}
    assert sum(other[i] != x for i, x in again.items()) > 80


def brute_merge(model, unit, variant, dropout, seed):
    """The agenda one merge at a time."""
    from marginalia.llm.words import mix

    u = np.uint64
    key = mix(mix((u(zlib.crc32(unit)) << u(20)) ^ u(variant)) ^ u(seed))
    ids = [(x, k) for k, x in enumerate(model.symbols([unit])[0].tolist())]
    table = dict(zip(model.pair.tolist(), model.merged.tolist()))
    limit = int(dropout * 2**64)
    while True:
        found = []
        for k in range(len(ids) - 1):
            new = table.get(ids[k][0] * model.size + ids[k + 1][0])
            if new is not None and not (dropout and int(mix(key ^ u(ids[k][1] * model.size + new))) < limit):
                found.append((model.rank[new], k, new))
        if not found:
            return [x for x, _ in ids]
        _, k, new = min(found)
        ids[k : k + 2] = [(new, ids[k][1])]


def test_merge_dropout_against_an_agenda(monkeypatch):
    model = piece_dropout.piece_model(piece_dropout.default_model())
    units = [b" international", b" the", b"\n", " naïve".encode(), b" aaaaaaa", b" xyzzyxyzzy", b" " + b"internationalthe" * 9, b" " * 90 + b"x"]
    for remembered in (piece_dropout.REMEMBERED, 0):
        monkeypatch.setattr(piece_dropout, "REMEMBERED", remembered)
        monkeypatch.setattr(piece_dropout, "BLOCK", 5)
        for dropout in (0.0, 0.1, 0.5):
            index, drawn = np.tile(np.arange(len(units)), 3), np.repeat([0, 3, 4], len(units)).astype(np.uint64)
            ids, count = piece_dropout.Agendas(model).encode(units, index, drawn, dropout, 9)
            parts = np.split(ids, np.cumsum(count)[:-1])
            for k, (u, v) in enumerate(zip(units * 3, drawn)):
                assert parts[k].tolist() == brute_merge(model, u, int(v), dropout, 9)


def test_a_unit_of_many_letters():
    model = piece_dropout.piece_model(piece_dropout.default_model())
    text = "".join(random.Random(3).choices("abcdefgh中é", k=300_000))
    for dropout in (0.0, 0.1):
        ids, ends = piece_dropout.encode(model, pa.array([text, "", None]), np.arange(3), dropout, 1)
        assert model.decode(ids.tolist()) == text and ends.tolist() == [len(ids)] * 3
    assert piece_dropout.encode(model, pa.array([], pa.string()), np.arange(0), 0.1, 1)[1].tolist() == []


def test_every_occurrence_has_draws_of_its_own():
    from marginalia.llm.words import mix

    model, u = piece_dropout.piece_model(piece_dropout.default_model()), np.uint64
    words = ["the", "of", "a", "international", "naïve", "xyzzy" * 20, "é中"]
    texts = [" ".join(words[(d + k) % len(words)] for k in range(40)) for d in range(12)] + ["", "the\n the"]
    docs = np.arange(len(texts)) - 1
    for dropout in (0.1, 0.5, 1.0):
        ids, ends = piece_dropout.encode(model, pa.array(texts), docs, dropout, 9)
        begin = 0
        for d, t, e in zip(docs, texts, ends.tolist()):
            units = [x.encode() for x in re.findall(r"\n| +[^ \n]*|[^ \n]+", " " + t)] if t else []
            drawn = [mix(mix(np.array([d]).view(u) ^ u(9)) + u(k))[0] for k in range(len(units))]
            assert ids[begin:e].tolist() == [x for w, v in zip(units, drawn) for x in brute_merge(model, w, v, dropout, 9)]
            begin = e
    ids, ends = piece_dropout.encode(model, pa.array(["of"] * 3000), np.arange(3000), 0.1, 42)
    seen = Counter(tuple(x) for x in np.split(ids, ends[:-1]))
    whole = tuple(brute_merge(model, b" of", 0, 0.0, 42))
    assert 0 < sum(n for x, n in seen.items() if x != whole) / 3000 < 0.5
    many, stops = piece_dropout.encode(model, pa.array(["international"] * 3000), np.arange(3000), 0.1, 42)
    assert len({tuple(x) for x in np.split(many, stops[:-1])}) > 4


# ---- 9 ----


def brute_near(rows, k, threshold=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.fixture(scope="module")
def family():
    rng = random.Random(9)
    base = prose(rng, 120, 10**6).split()
    rows = [*ODD, "Word", "A B", "a b c"]
    for k in range(150):  # a star: most copies are nearer to the base than to each other
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    chain = prose(rng, 100, 10**6).split()
    for k in range(25):  # a chain: neighbours alone are near
        chain = list(chain)
        for j in range(3):
            chain[(k * 4 + j) % 100] = f"y{k}{j}"
        rows.append(" ".join(chain))
    rows += [prose(rng, rng.randrange(1, 200)) for _ in range(150)] + [rows[30]] * 40
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "task", "bucket"), [(2, 128, 512), (2, 10, 20), (5, 10, 8)])
def test_near_duplicates(spark, family, monkeypatch, k, task, bucket):
    monkeypatch.setattr(minhash_dedup, "TASK", task)
    monkeypatch.setattr(minhash_dedup, "BUCKET", bucket)
    monkeypatch.setattr(minhash_dedup, "BLOCK", task * 2)
    df = table(spark, [t for _, t in family])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df, k).collect()}
    assert got == brute_near(family, k)


def test_near_duplicate_edges(spark):
    assert minhash_dedup.near_duplicates(table(spark, []), 2).count() == 0
    assert [r.kept for r in minhash_dedup.near_duplicates(table(spark, [None, None, ""]), 2).collect()] == [True] * 3
    left = minhash_dedup.without_near_duplicates(table(spark, ["a b c d e f", "x", "a b c d e f"]))
    assert sorted(r.doc_id for r in left.collect()) == [0, 1] and left.columns == table(spark, []).columns


def test_near_duplicates_of_pages_from_a_template(spark, monkeypatch):
    for name, value in (("TASK", 8), ("BUCKET", 6), ("BLOCK", 16)):
        monkeypatch.setattr(minhash_dedup, name, value)
    rng = random.Random(19)
    template = prose(rng, 75, 10**6)
    texts = [f"{template} {prose(rng, 25, 10**6)}" for _ in range(150)]  # about 0.6 alike: one cluster, no links
    texts += [texts[k] + " tail" for k in range(0, 150, 10)] + [texts[k] for k in range(5)]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(table(spark, texts), 2).collect()}
    assert got == brute_near(rows, 2)


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(5, a), (5, a), (5, b), (7, a + " x"), (2, b + " y"), (2, c), (9, c), (None, a), (None, None), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "p") for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash_dedup.near_duplicates(df).collect())
    want = [("5", 76, "5", True)] * 2 + [("5", 76, "2", False), ("7", 77, "5", False), ("2", 77, "2", True), ("2", 76, "2", True), ("9", 76, "2", False)]
    assert got == sorted([*want, ("None", 76, "None", True), ("None", 0, "None", True), ("4", 0, "4", True)])
    left = sorted((str(r.doc_id), str(r.text)) for r in minhash_dedup.without_near_duplicates(df).collect())
    assert left == sorted([("5", a), ("2", b + " y"), ("2", c), ("None", a), ("None", "None"), ("4", "")])


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 800, dtype=np.uint64)
    a, b = np.unique(common), np.unique(np.concatenate([common[:700], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    one = np.array([7], np.uint64)
    s = minhash_dedup.sketches(np.concatenate([a, b, one]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1]))
    assert (s != 0).all()
    assert abs((s[0] == s[1]).mean() - 700 / 900) < 0.15


def test_components(spark):
    rng = random.Random(11)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in links for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    rng.shuffle(links)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up if any(i in e and e[0] != e[1] for e in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 10 ----


def test_chunks_cover_texts():
    texts = [b"", b"a" * 255, b"b" * 256, bytes(range(1, 250)) * 9]
    rows, first = byte_cnn.chunked(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    s, w = byte_cnn.STRIDE, byte_cnn.WIDTH
    for t, a, b in zip(texts, first, first[1:]):
        padded = t + b"\0" * ((b - a) * s + w - 1 - len(t))
        assert [r.tobytes() for r in rows[a:b]] == [padded[k * s : (k + 1) * s + w - 1] for k in range(b - a)]


def test_network_against_plain_loops():
    rng = np.random.default_rng(13)
    f, w, s = byte_cnn.FILTERS, byte_cnn.WIDTH, byte_cnn.STRIDE
    net = byte_cnn.Network(
        rng.normal(0, 0.3, (w, 256, f)), rng.normal(0, 0.3, f), rng.normal(0, 0.3, (3 * f, byte_cnn.HIDDEN)),
        rng.normal(0, 0.3, byte_cnn.HIDDEN), rng.normal(0, 0.3, byte_cnn.HIDDEN), 0.1,
    )
    texts = [b"abc", bytes(rng.integers(1, 255, 700, dtype=np.uint8)), bytes(rng.integers(97, 122, 256, dtype=np.uint8))]
    scores = byte_cnn.score(net, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for text, got in zip(texts, scores):
        pooled = []
        for c in range(max(1, -(-len(text) // s))):
            part = text[c * s : c * s + s + w - 1].ljust(s + w - 1, b"\0")
            pooled.append([max(0, max(sum(net.table[k][part[p + k]][j] for k in range(w)) for p in range(s)) + net.bias[j]) for j in range(f)])
        x = [fn(col) for fn in (lambda c: sum(c) / len(c), max, min) for col in zip(*pooled)]
        hidden = [max(0, sum(a * b for a, b in zip(x, net.w1[:, h])) + net.b1[h]) for h in range(byte_cnn.HIDDEN)]
        assert abs(got - 1 / (1 + np.exp(-(sum(a * b for a, b in zip(hidden, net.w2)) + net.b2)))) < 1e-5
    # Derivatives against differences.
    rows, first = byte_cnn.chunked(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 2.0])
    _, g = byte_cnn.gradients(net, rows, first, y, weight)
    for name, at in (("w2", (3,)), ("b1", (2,)), ("w1", (5, 1)), ("w1", (f + 3, 4)), ("w1", (2 * f + 1, 0)), ("bias", (4,)), ("table", (2, texts[1][300], 6)), ("table", (0, 98, 1))):
        value, step = getattr(net, name), 1e-4
        kept, losses = value[at], []
        for d in (step, -step):
            value[at] = kept + d
            losses.append(byte_cnn.gradients(net, rows, first, y, weight)[0])
        value[at] = kept
        assert abs((losses[0] - losses[1]) / (2 * step) - g[name][at]) < 2e-3, name


def test_sample_takes_whole_long_texts(spark):
    texts = ["a" * 20_000, "b" * 30_000, "c", "d", *["e" * 10] * 60]
    docs, labels = table(spark, [*texts, None]), spark.createDataFrame([(i, i % 2, 0) for i in range(65)], "doc_id long, quality int, toxic int")
    can = [i for i in range(65) if zlib.crc32(str(i).encode()) % 5]
    some = byte_cnn.sample(docs.union(docs.where("doc_id < 4")), labels)
    assert sorted(t for t, _ in some) == sorted((texts + [""])[i] for i in can)
    assert len({q for _, q in byte_cnn.sample(docs, labels, chars=1)}) == 2 and len(byte_cnn.sample(docs, labels, each=5)) == 10


def test_classifier(spark):
    rng = random.Random(12)
    texts = [prose(rng, 60) if i % 3 else " ".join(f"{w.upper()}!!" for w in prose(rng, 60).split()) for i in range(400)]
    docs = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(400)] + [(None, 1, 0), (7, 5, 0)], "doc_id long, quality int, toxic int")
    got = byte_cnn.classify(docs, labels).toPandas().set_index("doc_id")
    assert len(got) == 402 and got.score.between(0, 1).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(402))
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert byte_cnn.accuracy(got.reset_index(), labels.where("quality < 2").toPandas()) > 0.95
    assert byte_cnn.classify(docs.limit(0), labels).count() == 0 and byte_cnn.classify(docs, labels.limit(0)).first().score == 0.5
    assert got.score[400] == got.score[401]
    none = byte_cnn.classify(docs, labels.where("quality = 1")).toPandas()
    assert none.score.nunique() == 1 and none.score[0] == 1.0


def test_texts_of_megabytes_and_empty_tables(spark):
    """More than a slice of text in one row, beside short rows; and no rows at all."""
    rng = random.Random(63)
    big = "\n".join(prose(rng, 50, 10**6) for _ in range(30_000))
    assert len(big) > common.SLICE_BYTES
    docs = table(spark, ["a b", big, None, "password=f3a9c1d7b2e84f60a1c5d9e7 " + big[:200_000], "x" * 300_000]).repartition(1)
    none = docs.limit(0)
    sha = hashlib.sha256(big.encode() + b"\0" * (-len(big.encode()) % 64)).hexdigest()
    assert {r.doc_id: r.payload_sha256 for r in telephony.telephony(docs, files=False).collect()}[1] == sha
    assert all(r.lossless for r in piece_dropout.piece_dropout(docs, with_ids=False).collect())
    for pack in (sos_packing.sos_pack, bfd_packing.bfd_pack):
        assert pack(docs).count() > 200 and pack(none).count() == 0
    assert {r.doc_id: r.n_words for r in line_quality.line_quality(docs).collect()}[1] == len(big.split())
    assert license_scan.license_scan(docs).count() == 5 and license_scan.license_scan(none).count() == 0
    assert {r.doc_id: r.n_assign for r in secret_scan.secrets(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0}
    words = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    assert words[1] == (len(big.split()), 0) and words[3][1] > len(big[:200_000].split()) - 5
    assert minhash_dedup.near_duplicates(docs).count() == 5
    assert byte_cnn.classify(docs, spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")).count() == 5
    assert piece_dropout.piece_dropout(none).count() == 0 and telephony.telephony(none).count() == 0


def test_rows_without_doc_id(spark):
    text = "a b c d e f g h " * 9
    df = table(spark, [text, "x", None]).union(spark.createDataFrame([(None, text, None, None, None, None, None)], SCHEMA))
    assert telephony.telephony(df).count() == 4 and sos_packing.sos_pack(df).count() == 4 and license_scan.license_scan(df).count() == 4
    assert sorted(str(d) for r in bfd_packing.bfd_pack(df).collect() for d in r.doc_ids) == ["0", "1", "2", "None"]
    assert line_quality.line_quality(df).count() == 4 and secret_scan.secrets(df).count() == 4 and piece_dropout.piece_dropout(df).count() == 4
    assert substring_dedup.remove_repeats(df).count() == 4 and substring_dedup.without_repeats(df).count() == 4
    assert minhash_dedup.near_duplicates(df).count() == 4 and minhash_dedup.without_near_duplicates(df).count() == 4
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert byte_cnn.classify(df, labels).count() == 4


def test_pipeline_stages_keep_rows_without_doc_id(spark):
    live, prose_ = "password = f3a9c1d7b2e84f60a1c5d9e7", " ".join(f"u{i}" for i in range(60))
    none = [prose_, prose_ + " v", f"{live} one", f"two {live}", "x", None, "la " * 80]
    df = table(spark, [prose_ + " w", "three"]).union(spark.createDataFrame([(None, t, "en", "s", len(t or ""), 0, "p") for t in none], SCHEMA))
    texts = lambda out: sorted(str(r.text) for r in out.collect())
    assert texts(line_quality.without_boilerplate(df)) == sorted([prose_, prose_ + " v", prose_ + " w"])
    want = [prose_ + " w", "three", prose_, prose_ + " v", "[secret] one", "two [secret]", "x", "None", "la " * 80]
    clean = secret_scan.redact(df.union(df.where("text = 'x'")))
    assert texts(clean) == sorted([*want, "x"]) and clean.columns == df.columns
    assert all(r.n_chars == len(r.text or "") for r in clean.collect())
    # An equal text in a row with a doc_id is judged by that id.
    assert texts(secret_scan.redact(table(spark, [f"{live} one"]).union(df.where("text like '%one'")))) == ["[secret] one"] * 2


def test_few_links_need_no_rounds(spark, monkeypatch):
    rng = random.Random(11)
    links = [(rng.randrange(400) - 50, rng.randrange(400) - 50) for _ in range(220)] + [(k, k + 1) for k in range(2**40, 2**40 + 30)] + [(7, 7), (2**62, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    monkeypatch.setattr(components, "FEW", -1)
    by_rounds = sorted(tuple(r) for r in components.components(df).collect())
    monkeypatch.undo()
    monkeypatch.setattr(components, "_is_stars", lambda _: pytest.fail("a round of tasks"))
    assert sorted(tuple(r) for r in components.components(df).collect()) == by_rounds
