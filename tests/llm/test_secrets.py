import random
import re
import string

from tidemark.llm.secret_scan import find_secrets, redact_secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def corpus(seed):
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    word = lambda: rng.choice(["reading", "temperature", "configurationmanager", "internationalization", "éclair", "the", "Straße"])
    secret = lambda: rng.choice(
        [
            lambda: f'{rng.choice(["Password", "api_key", "APIKEY", "secret", "ſecret", "token"])}{rng.choice(["=", ": ", chr(34) + " : "])}{pick(string.ascii_letters, rng.choice([3, 5, 6, 12]))}',
            lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, rng.choice([3, 15, 16, 20])),
            lambda: pick("0123456789abcdef", rng.choice([23, 24, 40])),
        ]
    )()
    texts = [None, "", "   ", "password=", "AKIA", "token: token=abcdefgh"]
    for _ in range(150):
        parts = [word() for _ in range(rng.randrange(1, 30))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), secret())
        texts.append(" ".join(parts))
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")


def test_base_spans(spark):
    texts = corpus(1)
    for row in find_secrets(frame(spark, texts)).collect():
        found = [(s["kind"], s["start"], s["end"]) for s in row["secrets"]]
        assert [s for s in found if s[0] != "markov"] == base(texts[row["doc_id"]])
        assert found == sorted(found, key=lambda s: (s[1], ("assign", "access", "hex", "markov").index(s[0])))


def test_held_out_tokens(spark, folder):
    rng = random.Random(3)
    alphabet = string.ascii_letters + string.digits
    tokens = ["".join(rng.choices(alphabet, k=32)) for _ in range(60)]
    names = ["configuration_manager_of_the_session_2", "internationalization-temperature-reading9", "the_reading_of_the_temperature_sensor12"] * 20
    prose = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    texts = prose + [f"x {t} y" for t in tokens] + [f"x {t} y" for t in names]
    spans = {r["doc_id"]: r["secrets"] for r in find_secrets(frame(spark, texts)).collect()}
    start = len(texts) - 120
    assert sum(any(s["kind"] == "markov" for s in spans[start + k]) for k in range(60)) >= 57
    assert sum(any(s["kind"] == "markov" for s in spans[start + 60 + k]) for k in range(60)) == 0


def test_redaction(spark):
    texts = corpus(4)
    table = frame(spark, texts)
    rows = {r["doc_id"]: r for r in redact_secrets(table).collect()}
    assert len(rows) == len(texts)
    for key, text in enumerate(texts):
        assert not base(rows[key]["text"])
        if not base(text) and rows[key]["text"] != text:
            assert "<secret>" in rows[key]["text"]
        assert rows[key]["n_chars"] == len(rows[key]["text"] or "")
    assert all(rows[k]["text"] == t for k, t in enumerate(texts[:5]))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert find_secrets(none).count() == 0 and redact_secrets(none).count() == 0
