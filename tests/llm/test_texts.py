import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fabula.llm.mixing import fill, knapsack, mix_sources
from fabula.llm.residue import clean, kind_of, residue
from fabula.llm.tokens import DEFAULT_PATH, encode, vocabulary

V = vocabulary(DEFAULT_PATH)


def reference():
    import base64

    import tiktoken

    from fabula.llm.tokens import PATTERN

    with open(DEFAULT_PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


REF = reference()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeinrstlou ' -éè", max_size=80), st.sampled_from(["<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "   \n\n \t x", "𝔖é́安全", "I'll we've l'eau 12345"])))
def test_ids_equal_the_public_encoder(text):
    assert V.ids(text) == REF.encode_ordinary(text) and V.count(text) == len(V.ids(text))


def test_encode(spark):
    long = "soudure " * 40_000 + "z" * 3_000
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Bonjour", "c"), (3, "Bonjour", "c"), (None, "x", "d"), (4, long, "e")], "doc_id long, text string, ids string")
    got = encode(df).collect()
    assert len(got) == 6 and [r.ids for r in got if r.doc_id in (1, 2)] == [[], []]
    assert [r.ids for r in got if r.doc_id == 4] == [REF.encode_ordinary(long)]
    assert encode(df.limit(0)).count() == 0


def test_knapsack_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths, counts, room = sorted({int(x) for x in rng.integers(1, 20, 4)}), None, int(rng.integers(0, 60))
        counts = [int(x) for x in rng.integers(0, 4, len(lengths))]
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = knapsack(room, lengths, counts)
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[lengths.index(n)] for n, k in got.items())


def test_fill():
    lengths, counts = np.array([3, 10, 50]), np.array([100, 50, 20])
    total = int((lengths * counts).sum())
    for goal, uses in ((0, 3), (777, 1), (total, 2), (2.5 * total, 3), (9 * total, 3)):
        n, extra = fill(goal, lengths, counts, uses, 1)
        drawn = n * total + int((extra * lengths).sum())
        assert (extra <= counts).all() and n + (extra > 0).any() <= uses
        assert drawn <= goal and (goal - drawn < 3 or n == uses)


def test_mix(spark):
    docs = [(i, "mot " * (i % 7), f"s{i % 3}", "u") for i in range(300)] + [(500, "x y z", None, "u"), (None, "x", "s0", "u"), (501, None, "s1", "u"), (7, "mot " * 0, "s1", "u")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, uses string")
    t = spark.createDataFrame([(1, "s0", 0.5, 2, 900), (1, "s1", 0.4, 1, 900), (1, "none", 0.1, 5, 900), (2, "s2", 1.0, 1, 100_000), (3, "s0", None, 1, 10)], "mix_id int, source string, target_weight double, max_uses int, budget_tokens long")
    draws, report = mix_sources(df, t)
    rep = {(r.mix_id, r.source): r for r in report.collect()}
    assert rep[1, "none"].short and rep[2, "s2"].short and rep[2, "s2"].drawn_tokens == rep[2, "s2"].source_tokens
    assert 447 <= rep[1, "s0"].drawn_tokens <= 450 and rep[3, "s0"].drawn_tokens == 0
    assert draws.groupBy("mix_id", "source", "doc_id").count().where("count > 1").isEmpty()
    size = {i: V.count(x) for i, x, *_ in docs if i is not None}
    assert sum(size[r.doc_id] * r.uses for r in draws.where("mix_id = 1 and source = 's0'").collect()) == rep[1, "s0"].drawn_tokens
    d, r = mix_sources(df.limit(0), t)
    assert d.count() == 0 and r.where("drawn_tokens > 0").count() == 0
    assert mix_sources(df, t.limit(0))[1].count() == 0


CASES = [
    ("Dossier suivi par {{ responsable }}.", "place"), ("Objet : accident à ${lieu}", "place"), ("Établissement : <%= service %>", "place"), ("La victime, @@nom@@, va bien.", "place"),
    ("Site : [DATE_ACCIDENT]", "place"), ("Lieu : «numero_dossier»", "place"), ("La personne (%NOM_VICTIME%)", "place"), ("Poste : __poste__", "place"), ("Le {0} juin", "place"),
    ("Date : XX/XX/XXXX", "place"), ("Lieu : ............ (préciser)", "place"), ("(à renseigner par le service)", "place"), ("*** COMPLÉTER ICI ***", "place"), ("Le poste était undefined.", "place"), ("File handled by TODO.", "place"),
    ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do", "filler"), ("test test test", "filler"), ("Saisir ici la description.", "filler"), ("abc, abc, abc, abc, abc, abc, abc", "filler"), ("qsdf asdf jklm azerty wxcv", "filler"),
    ("Erreur 404 : la page demandée est introuvable.", "page"), ("Veuillez activer JavaScript pour afficher cette fiche.", "page"), ("HTTP 500 - the server met an unexpected condition. Contact support.", "page"), ("java.lang.NullPointerException\n\tat a.b.C.d(C.java:3)", "page"), ("Bitte erlauben Sie Cookies und Skripte im Browser.", "page"),
    (None, None), ("", None), (" \n\t ", None), ("Un maçon a glissé sur le chantier de Bourville et s'est blessé au genou.", None),
    ("Un modèle de lettre avec le repère {{site}} a été corrigé avant envoi, rappelle la note du chef de chantier ce matin.", None), ("The clerk noted that the template marker {{site}} had been corrected before sending the report to us.", None),
    ("Le plan porte la mention [zone B] et la cote <12 mm>. L'agent a été évacué vers l'infirmerie avec un arrêt de 3 jours.", None), ("La liste « TODO » du chef d'équipe datait de la veille, personne ne l'avait relue avant la reprise du chantier.", None),
    ("L'afficheur de la commande indiquait « erreur 404 » au moment des faits ; le cariste a reculé sans voir son collègue et l'a heurté.", None), ("Responsibilities had been left undefined in the plan of the works council meeting.", None),
    ("Pièce [[UF40769]] (12) et capteur {ZP68871}, relevé : {débit: 40, unité: l/min}, voir https://intranet.invalid/fiche?id=42&v=%C3%A9", None),
    ("Tutoriel : la syntaxe du moteur de gabarits.\n```\nBonjour {{ nom }}, {{ lieu }}\n```\nFin de la leçon sur les gabarits de lettres.", None),
]


@pytest.mark.parametrize(("text", "kind"), CASES)
def test_kind(text, kind):
    assert kind_of(text) == kind


def test_residue(spark):
    long = " ".join(f"Le grutier {k} a levé la charge {k * 7} puis la passerelle n{k} a vibré." for k in range(20_000))
    rows = [(i, t, "k") for i, (t, _) in enumerate(CASES)] + [(900, long, "k"), (901, long + " Lieu : {{lieu}}", "k"), (None, "test test test", "k"), (0, CASES[0][0], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r.doc_id for r in residue(df).where("doc_id is not null").collect()}
    assert got == {i for i, (_, k) in enumerate(CASES) if k} | {901}
    assert residue(df.limit(0)).count() == 0 and clean(df).where(F.col("doc_id") == 901).count() == 0 and clean(df).where(F.col("doc_id") == 900).count() == 1


FRAMES = "\n".join(f"\tat org.site.app.Fiche{k}.ouvrir(Fiche{k}.java:{k})" for k in range(60))
BODY = '{"timestamp": "2024-01-05", "error": {"code": 500, "message": "The request could not be handled", "causes": [' + ", ".join(f'"step {k} of the job did not answer in time"' for k in range(30)) + ']}, "path": "/fiche"}'
NARRATIVE = " ".join(f"Le grutier {k} a levé la charge {k * 7}, puis la passerelle n{k} a vibré." for k in range(60))
LONG = [
    ("java.lang.NullPointerException: fiche\n" + FRAMES, "page"),
    ("java.lang.IllegalStateException: x\n" + FRAMES + "\nCaused by: java.io.IOException: y\n" + FRAMES + "\n\t... 23 more", "page"),
    ("Traceback (most recent call last):\n" + "\n".join(f'  File "/app/m{k}.py", line {k}, in f{k}\n    return g{k}(self, x, y)' for k in range(40)) + "\nKeyError: 'lieu'", "page"),
    (BODY, "page"),
    ("\n".join(f"Erreur 503 : le service fiche{k} est indisponible." for k in range(80)), "page"),
    (NARRATIVE, None),
    (NARRATIVE + "\nErreur 503 : le service est indisponible.\n" + FRAMES, None),
    (NARRATIVE.replace(".", ",") + " et une erreur 503 est apparue", None),
    ('{"error": "timed out", "recit": "' + NARRATIVE + '"}', None),
]


@pytest.mark.parametrize(("text", "kind"), LONG)
def test_pages_of_any_length(text, kind):
    assert kind_of(text) == kind


@pytest.mark.parametrize("n", [69, 160, 161, 250, 345, 5000])
@pytest.mark.parametrize("sep", [", ", ",", " - ", ". "])
def test_filler_of_any_length(n, sep):
    from fabula.llm.residue import FILLER_WORDS

    words = sorted(FILLER_WORDS)[:69]
    assert kind_of(sep.join(words[k % 69] for k in range(n)) + ".") == "filler"


MESSAGES = """page introuvable|la page n'existe plus|elle a été déplacée|l'adresse a changé d'adresse|le serveur ne répond pas|service hors ligne|indisponible|page accessible|réservée aux membres|n'a pas pu être chargée
ne peut pas être affichée|accès refusé|accès interdit|la session a expiré|erreur 500|erreur interne|délai d'attente|impossible d'ouvrir|pas les droits|lien périmé|not found|could not be loaded|no longer here|has moved|cannot be displayed
can't be reached|did not respond|closed for maintenance|cerrado por mantenimiento|en wartung|wegen wartung|unexpected condition|requires you to sign in|you do not have permission|access denied|timed out|bad gateway|internal server error|too many requests
unavailable|http 503|connection refused|uncaught|exception|traceback|keyerror|undefined variable|sqlstate|fatal error|stack trace|error 404|segmentation fault|nicht gefunden|nicht erreichbar|nicht mehr|keine berechtigung|serverfehler
abgelaufen|verweigert|fehler 404|antwortet nicht|angemeldete|no se encuentra|no se ha podido|no está disponible|no responde|denegado|no tiene permiso|no puede mostrarse|error interno|ha caducado|ya no existe|membres connectés|log in again
"error": 1|"status" : 2|activez javascript|cookies must be allowed|enable scripts|le contenu actif est bloqué|aktive inhalte erlauben|contenido activo necesita|votre navigateur bloque les scripts|viewer requires active content|something went wrong
an error has occurred|une erreur s'est produite|veuillez vous reconnecter|fehler ist aufgetreten|zugriff gesperrt|se ha producido un error|algo salió mal|acceso restringido|connexion perdue|verbindung verloren|conexión rechazada""".replace("\n", "|").split("|")


def test_every_message_has_a_stem():
    from fabula.llm.residue import ERROR, NOTICE, signs

    found = [m for m in MESSAGES if ERROR.search(m) or NOTICE.search(m)]
    assert len(found) > 80 and all(signs(m.lower())[0] for m in found)
    assert signs("ceci est un texte de remplissage") == (False, True) and signs("") == (False, False)


def test_more_placeholders_and_messages():
    for t in ("Le {nom} a été blessé.", "Victime : <<prénom>>.", "Le $lieu$ de l'accident.", "Heure : XXhXX.", "Poste XXXX.", "Coût : #N/A", "Lieu : ???"):
        assert kind_of(t) == "place", t
    assert kind_of("description, description, description, description") == "filler" and kind_of("Il a plu très, très, très fort sur le chantier de la gare.") is None
    # a name that ends like a word of mention is none
    for t in ("À Tamgrissechamp, __lieu__ travaillait seul.", "La résidence de Flaronochamp.\n\nLa {{ équipement }} a cédé.", "Datum des Ereignisses: *** ERGÄNZEN ***", "Le poste (veuillez indiquer) était vide."):
        assert kind_of(t) == "place", t
    assert kind_of("Le champ {{site}} du modèle a été corrigé avant envoi, rappelle la note.") is None
    for t in ("Something went wrong. Please try again.", "Une erreur s'est produite.", "Es ist ein Fehler aufgetreten.", "Se ha producido un error."):
        assert kind_of(t) == "page", t
    for t in ("Le XXe siècle, le chantier {no 12} et 5 $ par jour.", "La machine coûte 3 $ et la pièce 4 $ de plus."):
        assert kind_of(t) is None, t
