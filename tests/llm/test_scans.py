"""Secrets, personal data, toxicity and the pipeline."""

import random
import re
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import frames  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidemark.llm import personal, secret_scan, toxicity  # noqa: E402


def assigned(text):
    pattern = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", *m.span()) for m in re.finditer(pattern, text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_base_secrets_equal_plain_patterns():
    rng = random.Random(1)
    parts = ["password", "Secret", "api_key", "APIKEY", "token", "passwd", "=", ":", " ", "  ", '"', "'", "abcdef", "12", "AKIA", "ABCDEFGH12345678", "0a1b2c3d", "ſecret", "\n", "é", "-/+"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [s for s in secret_scan.spans(text) if s[0] != "lexed"] == assigned(text), repr(text)


def test_constants_reach_sensitive_names():
    text = 'db = "Tr0ub4dor&3x"\nconn.password = db\npart = "Zx81"\nAPI_KEY: str = part + "9QkLw77"\nname = "Gr33nHouse&9"\npassword_file = "/etc/S3cret9"\npwd: hunter2hunter2\n'
    found = [text[s:e] for k, s, e in secret_scan.spans(text) if k == "lexed"]
    assert found == ["Tr0ub4dor&3x", "Zx81", "9QkLw77", "hunter2hunter2"]
    assert secret_scan.spans('note = "plain words"\nuser: alice\ncolour = "#a1B2c3D4"') == []


def test_secret_edges(spark):
    got = secret_scan.find_secrets(frames.frame(spark))
    assert got.count() == len(frames.rows())
    assert sorted(r.doc_id for r in got.where("size(spans) > 0").collect()) == [10, 16]
    assert secret_scan.find_secrets(frames.empty(spark)).count() == 0
    for text in ("a:" * 50_000, "a=" * 50_000, '"' * 50_000, "x = x + x\n" * 3000, "f" * 300_000):
        secret_scan.spans(text)


def plain_marks(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def test_base_personal_data_equals_plain_patterns():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@", ".", "-", "x1", "10", "255", "256", "0001", " ", "+1", "(555)", "4111 1111", "1111-1111", "4111111111111111", "7", "\n", "é", "％", "٣"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        assert personal.marked(text) == plain_marks(text), repr(text)


def test_field_follows_repeated_tokens(spark):
    rng = random.Random(3)

    def document(k):
        number = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        return f"{frames.prose(rng, 6)} call {number} {frames.prose(rng, 6)} {number} {frames.prose(rng, 3)} {rng.randrange(10**5)} {frames.prose(rng, 3)}"

    docs = spark.createDataFrame([(k, document(k)) for k in range(200)], "doc_id long, text string")
    field = personal.fit(docs)
    text = "please call +1 (417) 555-7713 today or later 417-555-7713 but not 12345 of alpha"
    found = [(k, text[s:e]) for k, s, e in personal.spans(text, field)]
    assert ("phone", "+1 (417) 555-7713") in found and ("field_phone", "417-555-7713") in found
    assert "12345" in personal.masked(text, personal.spans(text, field))


def test_message_passing_is_exact_on_chains():
    rng = np.random.default_rng(0)
    field = personal.Field(rng.normal(size=(personal.N_FEATURES, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    nodes = personal.Nodes("a 12 b")
    unary, total = np.exp(nodes.x @ field.weights), np.zeros((3, 5))
    for i in range(5):
        for j in range(5):
            for k in range(5):
                p = unary[0, i] * unary[1, j] * unary[2, k] * np.exp(field.chain[i, j] + field.chain[j, k])
                total[[0, 1, 2], [i, j, k]] += p
    assert np.allclose(field.beliefs(nodes), total / total.sum(1, keepdims=True), atol=2e-2)


def test_personal_edges(spark):
    docs = frames.frame(spark)
    assert personal.find_personal(docs).count() == len(frames.rows())
    masked = personal.redact(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    text = masked.where("doc_id = 16").first().text
    assert not any(x in text for x in ("a.b@c", "10.2.3.4", "4111", "555-7713")) and "<EMAIL>" in text
    assert masked.where("doc_id = 5").first().text is None
    assert personal.redact(frames.empty(spark)).count() == 0 and personal.fit(frames.empty(spark)) is None


def test_toxicity_learns_and_tolerates_gaps(spark):
    rng = random.Random(4)
    insults = ["grobbler", "snivelwit", "dunderfloop"]

    def document(k):
        words = frames.prose(rng, 40).split()
        if k % 5 == 0:
            for _ in range(2):
                words[rng.randrange(40)] = rng.choice(insults)
        return ". ".join(" ".join(words[i : i + 8]) for i in range(0, 40, 8)) + "."

    docs = spark.createDataFrame([(k, document(k)) for k in range(900)], "doc_id long, text string")
    known = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(900)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    held = [r.doc_id for r in docs.where(toxicity.held_out(docs.doc_id)).collect()]
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = [(scores[i] >= 0.3) == (i % 5 == 0) for i in held]
    assert len(held) > 150 and np.mean(right) > 0.97
    altered = ["You grobbbler", "you s n i v e l w i t", "g-r-o-b-b-l-e-r.", "a dunderxfloop here", "ordinary alphabeta words", None, ""]
    got = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(altered)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert min(got[:4]) > 5 * max(got[4:]) and all(0 <= s <= 1 for s in got)


def test_toxicity_edges(spark):
    docs = frames.frame(spark)
    for known in (frames.labels(spark), frames.labels(spark, 17)):
        scored = toxicity.score(docs, toxicity.fit(docs, known)).collect()
        assert len(scored) == len(frames.rows()) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(frames.empty(spark), toxicity.fit(frames.empty(spark), frames.labels(spark, 5))).count() == 0


def test_kernel_is_one_for_equal_words_and_drops_slowly():
    kernel = toxicity.Kernel(["stupid", "alpha"])
    same, gap, other, none = kernel(["stupid", "stuupid", "table", ""])
    assert np.isclose(same[0], 1, atol=1e-5) and 0.3 < gap[0] < 1 and other[0] < 0.1 and none[0] < 0.1
    assert toxicity.Kernel(["stupid"])(["x" * 300 + "stupid" + "y" * 300])[0, 0] > 0


def stages(spark, folder, docs, known, bench):
    docs.write.parquet(f"{folder}/documents.parquet")
    known.write.parquet(f"{folder}/labels.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(folder))
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        yield name, frame


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(6)
    base = [". ".join(frames.prose(rng, 8) for _ in range(6)) for _ in range(40)]
    item = frames.prose(rng, 30)
    texts = {k: t for k, t in enumerate(base)}
    texts |= {100: base[3], 101: base[3], 102: base[4].replace(" ", "  "), 103: base[5] + " " + item, 104: "too short", 105: None, 106: ". ".join(frames.prose(rng, 9) for _ in range(5)) + " a.b@c.example.org."}
    docs = spark.createDataFrame([(k, t, "en", "s", 1, "own") for k, t in texts.items()] + [(7, base[7], "en", "s", 1, "own")], "doc_id long, text string, lang string, source string, n_chars long, bands string")
    known = spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(104, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    after = {name: frame for name, frame in stages(spark, tmp_path, docs, known, bench)}
    ids = {name: sorted(r.doc_id for r in f.collect()) for name, f in after.items()}
    assert set(ids["quality rules"]) >= set(range(40)) | {100, 103, 106} and not {104, 105} & set(ids["quality rules"])
    assert ids["MinHash near-dedup"] == sorted(set(range(40)) | {103, 106})
    assert ids["benchmark decontamination"] == sorted(set(range(40)) | {106})
    assert ids["PII"] == ids["byte-level BPE"] == ids["benchmark decontamination"]
    assert after["PII"].columns == docs.columns
    assert "<EMAIL>" in after["PII"].where("doc_id = 106").first().text


def test_pipeline_edges(spark, tmp_path):
    known, bench = frames.labels(spark, 17), spark.createDataFrame([(1, None), (None, "x y z w")], "item_id long, text string")
    for folder, docs in (("some", frames.frame(spark)), ("none", frames.empty(spark))):
        last = [f for _, f in stages(spark, tmp_path / folder, docs, known, bench)][-1]
        assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (last.count() == 0) == (folder == "none")


def test_digits_that_are_no_numbers_and_very_long_numbers(spark):
    texts = ["host 1.2.3.4² and ①.②.③.④ or 1.2.3.٤ call +1 (417) 555-7713", "ip 1.2.3." + "0" * 5000 + " and " + "0" * 5000 + "7.2.3.4", "9" * 5000 + ".1.1.1"]
    found = [[(k, t[s:e]) for k, s, e in personal.marked(t)] for t in texts]
    assert ("ip", "1.2.3.4") in found[0] and [k for k, _ in found[1]] == ["ip", "ip"] and not [k for k, _ in found[2] if k == "ip"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert personal.find_personal(docs).count() == personal.redact(docs).count() == 3


def test_fully_sensitive_names_take_plain_literals():
    text = 'passphrase = "correct horse battery staple"\ndb_pwd = "hunterhunterhunter"\npin = "839201938475"\npassword = pin\npass = "plain words only"\npassword_hint = "name of the first pet"\ntoken = "aaaaaaaaaaaa"\n'
    found = [text[s:e] for k, s, e in secret_scan.spans(text) if k == "lexed"]
    assert found == ["correct horse battery staple", "hunterhunterhunter", "839201938475"]


def test_constants_reach_their_names_over_any_chain():
    secret = "Xk29fQpl77"
    rng = random.Random(3)
    for n in (1, 2, 3, 10, 300):
        lines = ["password = n0", *(f"n{k} = n{k + 1}" for k in range(n)), f'n{n} = "{secret}"']
        for order in (lines, lines[::-1], rng.sample(lines, len(lines))):
            text = "\n".join(order)
            assert ("lexed", text.index(secret), text.index(secret) + len(secret)) in secret_scan.spans(text)
    text = 'password = a\na = b\nb = a\nb = c\nc = "' + secret + '"\nother = "Yk29fQpl78"'  # a circle
    assert [text[a:b] for k, a, b in secret_scan.spans(text) if k == "lexed"] == [secret]
    text = "password = a\na = b\nb = a"
    assert secret_scan.spans(text) == []


def test_values_are_scored_whole():
    found = lambda text: [text[a:b] for k, a, b in secret_scan.spans(text) if k == "lexed"]
    mixed = "".join(random.Random(7).choices("qwertzuiopQWERTZUIOP123456789!", k=6000))
    assert found(f'n = "{"z" * 4096}" + "{mixed}"\nsigning_key = n') == ["z" * 4096, mixed]
    assert found(f'signing_key = "{"z" * 4096}{mixed}"') == ["z" * 4096 + mixed]
    assert found(f'n = "{mixed}"\nsigning_key = "pre-${{n}}-post"') == [mixed, "pre-${n}-post"]
    parts = [f"x{k}Q" for k in range(6000)]
    text = "\n".join(['n0 = "x0Q"', *(f'n{k} = n{k - 1} + "{p}"' for k, p in enumerate(parts) if k), "signing_key = n5999"])
    assert found(text) == parts
    doubled = "\n".join(['n0 = "Xk29fQpl77"', *(f"n{k + 1} = n{k} + n{k}" for k in range(3000)), "signing_key = n3000"])
    assert found(doubled) == ["Xk29fQpl77"]


def test_joined_values_score_like_their_text():
    rng = random.Random(5)
    pieces = ["", " ", "xx", "x", "todo", "to", "do", "place", "holder", "aB3-", "  ab ", "Xk29fQ", "\u3000", "\u00e9\u5b57", "12345678"]
    for _ in range(3000):
        texts = rng.choices(pieces, k=rng.randrange(1, 6))
        whole, joined = secret_scan.Value("".join(texts)), secret_scan.Value.joined([secret_scan.Value(t) for t in texts])
        for score in (secret_scan.literal_score, secret_scan.plain_score):
            assert score(joined) == score(whole), texts
