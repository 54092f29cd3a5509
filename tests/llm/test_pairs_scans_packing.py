from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import mixing, packing, pairs, scans, tokens
from skerry.llm.crf import Crf


def test_crf_learns_transitions():
    rng = np.random.default_rng(0)
    xs, ys = [], []
    for _ in range(200):
        y = np.cumsum(rng.integers(0, 2, rng.integers(1, 7))) % 2
        xs.append(np.stack([np.ones(len(y)), y * 2.0 - 1 + rng.normal(size=len(y)) * 0.3], 1)), ys.append(y)
    m = Crf(2, 2).fit(xs, ys)
    got = m.decode(xs)
    assert np.mean(np.concatenate(got) == np.concatenate(ys)) > 0.98


TOPICS = ["invoice", "contract", "report", "storage unit", "price list", "travel policy", "data sheet", "archive team", "finance office", "safety manual"]
DE = ["Rechnung", "Arbeitsgruppe", "Preisliste", "Reiserichtlinie", "Sicherungskopie", "Garantieklausel", "Endfassung", "Finanzabteilung"]


def dialogue():
    """Sound pairs in two languages, and one pair of each defect by name."""
    rng = np.random.default_rng(1)
    t = lambda: TOPICS[int(rng.integers(len(TOPICS)))]
    u = lambda: DE[int(rng.integers(len(DE)))]
    out = []
    for i in range(260):
        out.append((f"e{i}", f"What does the {t()} say about the {t()} in 20{i % 20:02d}?", f"The {t()} covers the {t()} under the current terms. It was filed with the {t()} before the review."))
        out.append((f"d{i}", f"Was sagt die {u()} über die {u()} im Jahr 20{i % 20:02d}?", f"Die {u()} umfasst die {u()} seit der letzten Prüfung. Sie wurde mit der {u()} abgelegt."))
    q = "What does the invoice say about the contract?"
    bad = {
        "empty": (q, None), "empty2": (q, " \n… "), "truncated": (q, "The report covers the contract under the current terms. The travel policy splits the"), "truncated2": (q, "The report covers the data sheet under the current terms. The price li"),
        "refusal": (q, "I'm sorry, but I can't help with the contract."), "refusal2": (q, "Thank you for your question. No comment on the invoice. Is there anything else?"),
        "echo": (q, q.upper()), "echo2": (q, "You asked: " + q), "language": (q, "Die Rechnung umfasst die Preisliste seit der letzten Prüfung. Sie wurde mit der Endfassung abgelegt."),
        "": (q + " Please answer in German.", "Die Rechnung umfasst die Preisliste seit der letzten Prüfung. Sie wurde abgelegt."), "2": (q, "Yes."), "3": (None, "The report covers the contract under the current terms."),
    }
    return out + [("x-" + k, *v) for k, v in bad.items()], bad


def test_pair_defects(spark):
    rows, bad = dialogue()
    t0 = datetime(2024, 1, 1)
    m = []
    for i, (k, q, a) in enumerate(rows):
        m.append((f"q{k}", f"t{i % 7}", "user", q, t0 + timedelta(minutes=2 * i)))
        m.append((k, f"t{i % 7}", "assistant", a, t0 + timedelta(minutes=2 * i + 1)))
    m += [m[-1], ("lone", "z", "assistant", None, t0), ("n", "t0", "user", "q", None), ("s", "t1", "system", None, t0), ("w", "t1", "tool", "", t0)]
    df = spark.createDataFrame([(*r, None, "clash") for r in m], "id string, thread_id string, role string, content string, created_at timestamp, citations array<struct<source_file:string>>, word string").withColumn("metadata", F.lit(None).cast("string"))
    al = spark.createDataFrame([("user", "user"), ("assistant", "assistant"), ("system", "system")], "alias string, role string")
    got = {r.message_id: r.defect for r in pairs.pair_defects(df, al).collect()}
    for k in bad:
        assert got.get("x-" + k) == (k.rstrip("0123456789") or None), k
    assert sum(1 for k in got if not k.startswith("x-")) <= 3 and "lone" not in got
    assert pairs.pair_defects(df.limit(0), al).count() == 0


#: Refusals and sound answers in words of their own; nothing in the operator was written from them.
REFUSED = [
    'That is not something I am willing to talk about.',
    'This question falls outside my remit.',
    'I would prefer not to respond to that.',
    'We are not permitted to share such details.',
    'I have no intention of discussing the contract.',
    'Sadly, I am not allowed to tell you that.',
    'I must turn down your request.',
    'You will not get an answer from me on this.',
    "As a language model I can't comment on people.",
    'Regrettably I cannot be of assistance here.',
    'I refuse to speculate about the audit.',
    'My rules forbid me to speak about the invoice.',
    'Hierüber gebe ich keine Auskunft.',
    'Das darf ich Ihnen nicht sagen.',
    'Ich möchte mich dazu nicht äußern.',
    'Bedauerlicherweise kann ich dazu nichts sagen.',
    'Diese Frage kann ich nicht beantworten.',
    'Mir ist es untersagt, darüber zu sprechen.',
    'Zu diesem Thema schweige ich.',
    "Je ne souhaite pas m'exprimer sur ce point.",
    "Je n'ai pas le droit de vous le dire.",
    "Il m'est interdit d'en parler.",
    'Désolé, cette question reste sans réponse de ma part.',
    'Nous ne donnons aucun renseignement à ce propos.',
    'Je refuse de commenter le contrat.',
    'No estoy autorizado a hablar de eso.',
    'No quiero opinar sobre ese asunto.',
    'Me temo que no puedo decirle nada.',
    'Sobre eso no puedo dar información.',
    'Rechazo responder a esa pregunta.',
]
SOUND = [
    'The contract does not cover storage costs.',
    'Nobody has approved the invoice yet.',
    'No, it does not.',
    'The supplier cannot deliver before Friday.',
    'The committee refused the request in May.',
    'Without written consent the plan is not valid.',
    'It is not permitted to park in front of the unit.',
    'The answer was not found in the annex; the report gives 42 euros.',
    'Please ask the finance office for help with the form.',
    'The guidelines do not allow more than 5 days.',
    'Der Vertrag gilt nicht für Lagerkosten.',
    'Nein, noch nicht.',
    'Die Rechnung wurde nicht genehmigt.',
    'Man darf hier nicht parken.',
    'Der Ausschuss lehnt den Antrag ab.',
    'Le contrat ne couvre pas les frais.',
    'Non, pas encore.',
    'Le fournisseur ne peut pas livrer avant vendredi.',
    "La demande d'achat n'est pas valable sans accord écrit.",
    'El contrato no cubre los gastos.',
    'No, todavía no.',
    'El proveedor no puede entregar antes del viernes.',
    'La solicitud no es válida sin acuerdo escrito.',
]


def test_refusals_in_other_words():
    rng = np.random.default_rng(3)
    nouns = {"en": TOPICS, "de": DE, "fr": ["facture", "réunion", "procédure", "liste", "copie"], "es": ["factura", "lista", "copia", "oficina", "guía"]}
    ask = {"en": "What does the {} say about the {} under the current terms?", "de": "Was sagt die {} über die {} im nächsten Jahr?", "fr": "Que dit la {} au sujet de la {} dans la plupart des cas ?", "es": "¿Qué dice la {} sobre la {} en la mayoría de los casos?"}
    tell = {"en": "The {} covers the {} under the current terms. It was filed with the {} before the review.", "de": "Die {} umfasst die {} seit der letzten Prüfung. Sie wurde mit der {} abgelegt und ist gültig.", "fr": "La {} couvre la {} dans la plupart des cas. Elle est dans la {} depuis le printemps.", "es": "La {} cubre la {} en la mayoría de los casos. Se guarda con la {} desde la primavera."}
    some = lambda k, t: t.format(*(nouns[k][int(rng.integers(len(nouns[k])))] for _ in range(3)))
    questions, answers = ([some(k, t) for k, t in of.items() for _ in range(120)] for of in (ask, tell))
    s = pairs.Settings()
    model = pairs.language_model(questions + answers, s)
    words = pairs.Words(model)
    crf = pairs.train(questions, answers, set(), words, s)

    def judged(answer):
        words.learn([answer])
        k = list(ask)[pairs._leading(words.languages(pairs._TOKEN.findall(answer)))]
        return pairs.judge(crf, words, [(some(k, ask[k]), answer, 0)])[0][0]

    assert np.mean([judged(a) == "refusal" for a in REFUSED]) >= 0.75
    assert sum(judged(a) == "refusal" for a in SOUND) <= 2


def page(header, number, body, foot=False):
    return "\n".join([header, *body] + ["", number]) if foot else "\n".join([header, *body, number])


def test_scans(spark):
    fill = [["the storage unit reviews the contract and", "the annual report covers the storage unit", "the data sheet confirms the annual report."]] * 14
    rows = [(i, 1, i + 1, page("Quavel - The invoice" if i != 3 else "Quavel - The inv0ice", f"- {i + 1} -", b, i % 2 == 0)) for i, b in enumerate(fill)]
    rows[5] = (5, 1, 6, page("Quavel - The invoice", "- 6 -", ["the stor@ge unit reviews the con-", "tract and the annual rcport covers the", "well-known data sheet as in the well-", "known storage unit. It is 2O21 now"]))
    rows[6] = (6, 1, 7, page("Quavel - The invoice", "7", ["the well-known annual report covers the stor­", "age unit and the well-known contract ends"]))
    rows += [(100, 2, None, "loose page"), (101, 2, 1, None), (None, 1, 99, "x"), (102, 3, 1, "not a scan"), rows[5]]
    ch = spark.createDataFrame(rows, "id bigint, doc_id bigint, page_number int, content string").withColumn("page", F.lit("clash")).withColumn("line_no", F.lit(1))
    docs = spark.createDataFrame([(1, "scans"), (1, "scans"), (2, "scans"), (3, "wiki"), (None, "scans")], "doc_id bigint, source string")
    got = {(r.chunk_id, r.line_no, r.kind) for r in scans.scan_defects(ch, docs).collect()}
    assert {(i, 0, "running_header") for i in range(14)} <= got and (3, 0, "misread") not in got
    assert sum(1 for g in got if g[2] == "page_number") == 14
    assert {g[1] for g in got if g[0] == 5 and g[2] == "hyphen"} == {1} and {g[1] for g in got if g[0] == 5 and g[2] == "misread"} == {1, 2, 4}
    assert (6, 1, "hyphen") in got and not any(g[0] in (100, 102) for g in got)
    text = " ".join(r.text for r in scans.repaired_paragraphs(ch, docs).where("doc_id = 1").orderBy("paragraph_no").collect())
    assert "storage unit reviews the contract and the annual report" in text and "Quavel" not in text and "- 6 -" not in text
    assert scans.scan_defects(ch.limit(0), docs).count() == 0


def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "big" if i % 3 else f"s{i % 4}", "word " * int(rng.integers(1, 700)), 1) for i in range(400)]
    rows += [(1000, "big", "long " * 9000, 1), (1001, None, "none here", 1), (1002, "s1", None, 1), (1003, "s1", "", 1), (None, "s1", "x", 1), rows[0], rows[1]]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_tokens int")


SIZES = "container string, capacity_tokens int"


def test_packing(spark):
    d = docs(spark)
    sizes = spark.createDataFrame([("small", 512), ("large", 4096), ("bad", 0), (None, 9)], SIZES)
    rows = packing.packed(d, sizes, window=16).toPandas()
    assert set(rows.container) == {"small", "large"}
    used = rows.groupby(["container", "capacity_tokens", "container_id"]).n_tokens.sum().reset_index()
    assert (used.n_tokens <= used.capacity_tokens).all()
    counted = {r.doc_id: r.n_tokens for r in tokens.document_tokens(d).collect()}
    assert len(counted) == 402
    for kind, cap in (("small", 512), ("large", 4096)):
        mine = rows[rows.container == kind]
        assert mine.groupby("doc_id").n_tokens.sum().to_dict() == counted
        n = mine.groupby("doc_id").size()
        assert all(n[i] == (1 if t <= cap else -(-t // cap)) for i, t in counted.items())
        for _, g in mine.groupby("doc_id"):
            g = g.sort_values("piece_no")
            assert (g.start_token.values == np.concatenate([[0], g.n_tokens.cumsum().values[:-1]])).all()
        w = mine[(mine.window_no >= 0) & (mine.window_no < mine.window_no.max())]
        if kind == "small" and len(w):
            share = w[w.source == "big"].groupby("window_no").n_tokens.sum() / w.groupby("window_no").n_tokens.sum()
            assert (share.max() - share.min()) < 0.2
    fill = {r.container: r.fill for r in packing.fill_report(packing.packed(d, sizes)).collect()}
    assert fill["small"] > 0.97
    assert packing.packed(d.limit(0), sizes).count() == 0 and packing.packed(d, sizes.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.packed(d, sizes, most=1)


def test_best_fit():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 500).tolist()
    no = packing.best_fit(sizes, 100)
    load = np.bincount(no, sizes)
    assert load.max() <= 100 and len(load) <= 1.05 * sum(sizes) / 100 + 1 and packing.best_fit([], 5) == []


def test_mixing(spark):
    d = docs(spark)
    t = spark.createDataFrame([("big", 0.5, 1), ("s0", 0.2, 3), ("s1", 0.1, 2), ("missing", 0.1, 2), (None, 0.1, 1), ("s2", 0.0, 1)], "source string, target_share double, max_repeats int")
    rec, rep = mixing.mixture(d, t)
    rows, report = rec.toPandas(), {r.source: r for r in rep.collect()}
    assert set(report) == {"big", "s0", "s1", "missing"} and report["missing"].tokens == 0
    for s in ("big", "s0", "s1"):
        r = report[s]
        mine = rows[rows.source == s]
        assert mine.tokens_used.sum() == r.budget == r.tokens and r.repeats <= r.max_repeats and (mine.tokens_used <= mine.n_tokens).all()
        assert (mine[mine.tokens_used < mine.n_tokens].shape[0]) <= 1 and not mine.duplicated(["doc_id", "epoch"]).any()
        assert abs(r.share - r.target_share / 0.8) < 0.002
    small = mixing.mixture(d, t, total=5000)[1].collect()
    assert abs(sum(r.tokens for r in small) - 4000) <= 4
    assert mixing.mixture(d.limit(0), t)[0].count() == 0


def test_prefix_sums_and_token_slices(spark):
    rows = [(i, "hot" if i % 3 else "cold", (i * 37) % 101, i % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, mix int")
    got = {r.doc_id: r.before for r in tokens.prefix_sums(df, "source", "n_tokens", "mix", "doc_id").collect()}
    for s in ("hot", "cold"):
        total = 0
        for i, _, n, _ in sorted((r for r in rows if r[1] == s), key=lambda r: (r[3], r[0])):
            assert got[i] == total
            total += n
    enc = tokens.encoding(tokens.Tokenizer())
    text = "Some words, numbers 123 and  double spaces\n\nnew lines. " * 300
    assert tokens.count_tokens(text, enc, slice_=500) == len(enc.encode_ordinary(text))
    for odd in ("x" * 3000, "ab  cd\n\n " * 300, "x" * 1200 + " y" * 900 + "  z", "12 " * 700 + "é" * 800):
        assert tokens.count_tokens(odd, enc, slice_=500) == len(enc.encode_ordinary(odd))
