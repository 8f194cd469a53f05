"""Template residue, filler and error-page text (p10): delimiter-specific grammars, with context and density.

A text is residue if
  place   a place meant for a value holds a placeholder, an instruction to fill it in or the mark of an unset value;
  filler  most of its words are filler (sample text, pseudo-Latin, keyboard runs, one phrase over and over);
  page    it is an error message, or a notice that scripts or cookies must be allowed, with next to nothing else.
What only quotes or mentions such things is no case: code blocks are left out, a placeholder named as such just before is
discounted, a quoted word is, and marks around an actual value (a code, a place, a measure) are no placeholder.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Words that name a field of a form, in the corpus's four languages.
FIELDS = set(
    """nom prénom prenom victime responsable lieu service entreprise poste équipement equipement date accident numero numéro
    dossier site adresse téléphone telephone fonction titre société societe employeur salarié salarie
    name employee company equipment supervisor job title incident case number place location address phone employer victim department
    empresa lugar equipo expediente fecha suceso nombre trabajador dirección direccion puesto responsable víctima
    firma ort maschine unfalldatum aktenzeichen vorgesetzter vorgesetzte anschrift datum abteilung mitarbeiter""".split()
)
# Stems of instructions to fill something in.
FILL_IN = r"(?:compl[eéè]t|renseign|pr[eé]cis|rempli|saisi|ins[eé]r|fill|enter\b|specif|especific|rellen|introduc|ausf[uü]ll|auszuf|eingeb|eintrag|einzutrag|angeb|anzugeb|insert|indiqu|indicar|indicate\b|erg[aä]nz|nachzutrag|nachtrag|hinzuzuf|einzuf[uü]g|beschreiben\b|añad|agregar|ajouter|d[ée]crire\b|please\b|veuillez|bitte\b|por favor|to be (?:added|completed|defined|specified|confirmed)|à d[eé]finir)"
NAME = r"[\p{L}_][\p{L}_ ]{0,30}"
STRONG = regex.compile(rf"\{{\{{\s*({NAME})\s*\}}\}}|\$\{{\s*({NAME})\s*\}}|<%=?\s*({NAME})\s*%>|@@({NAME})@@|(?<![\p{{L}}\d_])__(\p{{L}}[\p{{L}}_ ]{{1,30}}?)__(?![\p{{L}}\d_])|\{{(\d{{1,2}})\}}")
WEAK = regex.compile(rf"\[\[\s*({NAME})\s*\]\]|«(?=\S)({NAME})(?<=\S)»|<({NAME})>|\[({NAME})\]|%({NAME})%|#({NAME})#|(?<![{{$])\{{({NAME})\}}(?!\}})|<<\s*({NAME})\s*>>|\$({NAME})\$")
BRACKETED = regex.compile(r"[(\[<]([^()\[\]<>]{2,80})[)\]>]|\*{3}([^*\n]{2,60})\*{3}")
INSTRUCTION = regex.compile(rf"^.{{0,24}}{FILL_IN}.{{0,40}}$", regex.I | regex.S)
UNSET = regex.compile(r"(?<![\w/])(?:XX/XX/XX(?:XX)?|JJ/MM/AAAA|TT\.MM\.JJJJ|DD/MM/(?:YYYY|AAAA))(?![\w/])|(?<!\w)TBD(?:-FIELD)?(?!\w)|(?<=[:(,]\s?)(?:null|NaN|None)(?=\s*(?:[.,;)\n]|$))|_{4,}|(?<=:\s*)\.{5,}|(?<!\w)XX+\s?[hH:]\s?XX+(?!\w)|(?<![\w-])X{4,}(?![\w-])|(?<!\w)#(?:N/A|REF!|VALUE!|NAME\?)|(?<=:\s*)\?{3,}")
UNDEFINED = regex.compile(r"(?<![\w$])undefined(?!\w)", regex.I)
ADJECTIVE = regex.compile(r"\b(?:left|leaves?|remain\w*|been|being|still|stay\w*|quite|largely|otherwise)\s+$", regex.I)
TODO = regex.compile(r"(?<![\w«\"“'‘])(?<![«\"“]\s)TODO(?![\w»\"”'’])(?!\s[»\"”])(?!\W{0,2}(?:-|\s)?(?:list|liste|lista)\b)")
LIST = regex.compile(r"\b(?:list|liste|lista)\s+\S{0,3}$", regex.I)
MENTION = regex.compile(r"(?<!\p{L})(?:rep[eè]re|marqueur|balise|marker|placeholder|marcador|marca|platzhalter|marke|variable|template|mod[eè]le|plantilla|vorlage|champ|campo|feld|syntax\w*|sintaxis)\P{L}{0,4}(?:\p{L}{1,10}\P{L}{1,3}){0,2}$", regex.I)
CODE = regex.compile(r"```.*?(?:```|\Z)|<(code|pre)\b.*?</\1>", regex.S | regex.I)
TUTORIAL = regex.compile(r"\b(?:tutorial|tutoriel|handlebars|mustache|jinja|moteur de (?:gabarit|template)s?|template engine|syntax|syntaxe)\b", regex.I)
#: What a text must hold for a grammar to be tried at all.
SIGNS_STRONG, SIGNS_WEAK = ("{", "<%", "@@", "__"), ("[", "«", "<", "%", "#", "{", "$")
SIGNS_UNSET = ("XX", "#N/A", "#REF!", "#VALUE!", "#NAME?", "???", "JJ/", "TT.", "DD/", "TBD", "null", "NaN", "None", "____", ".....")

# Filler sentences and filler words.
INVISIBLE = regex.compile(r"[\u200b-\u200f\u2060\ufeff\u00ad]")
FILLER_PHRASES = """texte d'exemple;texte de remplissage;paragraphe type;saisir ici;ne pas publier;à remplacer par;votre texte ici;sample text;placeholder copy
your text here;your description here;your content here;dummy text;replace it with;blindtext;mustertext;platzhaltertext;später der inhalt
texto de muestra;texto de relleno;texto de ejemplo;aquí irá;su texto aquí""".replace("\n", ";").split(";")
FILLER_WORDS = set(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim
    veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit
    esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
    asdf qsdf hjkl jklm wxcv azerty qwerty qwertz xxxx xxx zzz abc foo bar baz bla blah test testing""".split()
)
SURE_FILLER = FILLER_WORDS - set("sit sed do et ut in ex ea non qui id est eu test esse in bar".split())

SURE_BYTES = {w.encode() for w in SURE_FILLER}

#: What parts words: ASCII marks by bytes, the others by replacement.
NO_WORD = bytes(32 if chr(c) in ".,;:!?()[]{}<>\"|/\\*#_-'+=&%@~`^$" else c for c in range(256))
NO_WORD_WIDE = "«»“”–—…’"
AGAIN = regex.compile(r"\b(\w+)(?:\W+\1\b){2,}", regex.I)

# What error messages, notices and the frames of web pages say.
ERROR = regex.compile(
    r"introuvable|n'existe plus|(?:a été|été) déplacée?|a changé d'adresse|ne répond pas|hors ligne|indisponible|(?:n'est|pas) accessible|réservée? aux|n'a pas pu être|ne peut (?:pas )?être|accès (?:refusé|interdit)|session a expiré"
    r"|\berreur \d{3}|erreur interne|délai d'attente|impossible d|pas les droits|périmé|not found|could not be|no longer|has moved|can(?:not|'t) be (?:displayed|loaded|found|reached)|did not (?:respond|answer)|(?:for|pour|en|wegen) (?:maintenance|mantenimiento|wartung)|por mantenimiento|unexpected condition"
    r"|requires? you to (?:sign|log) in|do not have permission|(?:access|permission) denied|timed out|bad gateway|internal server error|too many requests|unavailable|\bhttp \d{3}|connection refused|uncaught|exception|traceback|keyerror|undefined variable|sqlstate|fatal error|stack trace|\berror \d{3}|segmentation fault"
    r"|nicht (?:gefunden|erreichbar|angezeigt|geladen|verfügbar|mehr)|berechtigung|serverfehler|abgelaufen|verweigert|fehler \d{3}|antwortet nicht|angemeldete|no se (?:encuentra|encontró|ha podido|pudo)|no está disponible|no responde|denegado|no tiene permiso|no puede mostrarse|error interno|ha caducado|ya no existe|membres connectés|log in again|sign in"
    r"|\"(?:error|status)\"\s*:"
    r"|something went wrong|an error (?:has )?occurred|isn't working|forbidden|unauthorized|connection (?:reset|timed)|could not connect|no route to host|out of memory|syntax error|rate limit|quota exceeded|invalid request|temporarily (?:down|overloaded)|verify (?:that )?you are|captcha"
    r"|erreur (?:s'est produite|est survenue|inattendue)|s'est mal passé|trop de requêtes|connexion (?:refusée|interrompue|perdue)|(?:en|sous) maintenance|temporairement (?:fermé|suspendu)|veuillez vous (?:re)?connecter"
    r"|fehler (?:ist )?aufgetreten|etwas ist schiefgelaufen|zu viele anfragen|zugriff (?:untersagt|gesperrt)|wird gewartet|verbindung (?:abgelehnt|unterbrochen|verloren)"
    r"|(?:producido|ocurrido) un error|algo (?:ha salido|salió) mal|demasiadas (?:solicitudes|peticiones)|acceso (?:prohibido|restringido)|conexión (?:rechazada|interrumpida|perdida)",
    regex.I,
)
#: A text without any of these holds neither an error message nor a notice (one stem for each case of ERROR and NOTICE).
STEMS = """introuvable;n'existe plus;déplacé;changé d'adresse;ne répond pas;hors ligne;indisponible;accessible;réservé;n'a pas pu être;ne peut ;accès refusé;accès interdit
session a expiré;erreur ;délai d'attente;impossible d;pas les droits;périmé;not found;could not be;no longer;has moved;cannot be;can't be;did not ;maintenance
mantenimiento;wartung;unexpected condition;you to ;permission;denied;timed out;bad gateway;server error;too many requests;unavailable;http ;connection refused
uncaught;exception;traceback;keyerror;undefined variable;sqlstate;fatal error;stack trace;error ;segmentation fault;nicht gefunden;nicht erreichbar
nicht angezeigt;nicht geladen;nicht verfügbar;nicht mehr;berechtigung;serverfehler;abgelaufen;verweigert;fehler ;antwortet nicht;angemeldete;no se encuentra
no se encontró;no se ha podido;no se pudo;no está disponible;no responde;denegado;no tiene permiso;no puede mostrarse;ha caducado;ya no existe
membres connectés;log in again;sign in;"error";"status";javascript;java script;cookie;script;contenu actif;active content;aktive inhalte;skript
contenido activo;navigateur;browser;navegador;viewer;something went wrong;an error ;isn't working;forbidden;unauthorized;connection reset;connection timed
could not connect;no route to host;out of memory;syntax error;rate limit;quota exceeded;invalid request;temporarily ;verify ;captcha;s'est mal passé;trop de requêtes
connexion ;temporairement ;veuillez vous ;schiefgelaufen;zu viele anfragen;zugriff ;gewartet;verbindung ;un error;algo ;demasiadas ;acceso ;conexión""".replace("\n", ";").split(";")
WHAT = r"(?:java ?script|cookies?|scripts?|scripting|contenu actif|active content|aktive inhalte|skripte?|contenido activo|navigateur|browser|navegador|viewer)"
ALLOW = r"(?:activ|autoris|accept|débloqu|désactivé|pris en charge|requiert|bloque|enabl|turn(?:ed)? on|allow|requir|need|without|relies|switched off|out of date|checking|necesita|permit|habilit|erlaub|aktivier|zulass|zugelassen|benötigt|blockier)"
NOTICE = regex.compile(rf"\b{WHAT}\b.{{0,90}}{ALLOW}|{ALLOW}.{{0,60}}\b{WHAT}\b", regex.I)
FRAME = regex.compile(
    r"^\W*(?:accueil|menu|home|inicio|start|portail|intranet)\b.{0,60}$|^(?:récit d'accident|incident narrative|unfallbericht|relato del suceso)\b.{0,14}$|identifiant de requête|request id|anfrage-id|\bid\. de solicitud|de solicitud:|retour à l'accueil|back to home|zurück zur startseite|volver al inicio"
    r"|contact(?:ez|e con|er)? (?:l'administrateur|le support|the administrator|support|el administrador)|wenden sie sich|si le problème persiste|if the problem persists|vérifiez (?:l'adresse|le lien)|check the address|réessay|try again|\bretry\b|erneut versuchen|inténtelo|reconnect|neu anmelden|vuelva a|merci de patienter|please wait|may take a few seconds|recharge|reload"
    r"|^(?:référence|reference|referencia|zeichen|site|standort|centro)\s*:.{0,24}$|^(?:rédigé le jour|written on day|erstellt am tag|redactado el día)\b.{0,10}$|^\W*(?:oups|oops|sorry|désolé|attention|hinweis|lo sentimos|id)\W*$|^\s*(?:at|file) \S+[(,\"].*$|^\W*$|slow down"
    r"|^\s*at .{1,300}:\d+\)?\s*$|^\s*(?:suppressed|caused by): \S+$|^\s*\.{3} \d+ (?:more|common frames omitted)\s*$",
    regex.I,
)
#: After a frame of this kind comes its line of code.
CODE_AFTER = regex.compile(r'^\s*file "[^"]*", line \d+', regex.I)
CLAUSE = regex.compile(r"(?<=[,;|])\s+")
# Fields of an error body, and values that say there is no error.
ERROR_FIELD = regex.compile(r"errors?|exception|stack_?trace|traceback|trace|fault", regex.I)
NO_ERROR = (None, False, 0, "", [], {}, "none", "ok", "no")
FIELD_WORDS = 8
NO_SEPARATOR = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalnum() or 0x80 <= c < 0xC0)
SEGMENT = 150
SENTENCE = regex.compile(r"(?<=[.!?])\s+|\n+")
WORD = regex.compile(r"[\p{L}\p{N}']+")
NAV = regex.compile(
    r"accueil \| prévention \| déclarer \| contact|menu > santé et sécurité > fiches|portail qse - espace membre|intranet sécurité v[\d.]+|home\s+reports\s+search\s+help|inicio · informes · ayuda|start / meldungen / suche|(?:récit d'accident|incident narrative|unfallbericht|relato del suceso) [a-z]{2}\d+|identifiant de requête\s*:\s*\S+|(?:request id|anfrage-id|id\. de solicitud):\s*\S+|retour à l'accueil|back to home|zurück zur startseite|volver al inicio",
    regex.I,
)
#: Words that a page may hold besides its message, at least and as a share; share of filler words that makes a text filler.
PAGE_REST, PAGE_SHARE, FILLER_SHARE = 6, 0.12, 0.5
QUOTED = regex.compile(r"«[^»\n]*»|\"[^\"\n]*\"|“[^”\n]*”")
#: So many words at most belong to each error or notice that a sentence holds; a longer sentence is looked at by clauses.
MESSAGE_WORDS = 40


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for x in FILLER_PHRASES:
        a.add_word(x, 2)
    for x in STEMS:
        a.add_word(x, a.get(x, 0) | 1)
    a.make_automaton()
    return a


SIGNS = _automaton()


def signs(low: str) -> tuple[bool, bool]:
    """Does a text in lower case hold a stem of an error message or notice, and a phrase of filler?"""
    seen = 0
    for _, bits in SIGNS.iter(low):
        seen |= bits
        if seen == 3:
            break
    return bool(seen & 1), bool(seen & 2)


def bare_words(low: str) -> list[bytes]:
    """The words of a text in lower case, marks taken off."""
    if not low.isascii():
        for c in NO_WORD_WIDE:
            low = low.replace(c, " ")
    return low.encode("utf-8", "replace").translate(NO_WORD).split()


def is_field(name: str) -> bool:
    parts = regex.split(r"[_\s]+", name.strip().lower())
    return "_" in name.strip("_ ") or all(p in FIELDS for p in parts if p) and any(parts)


def has_place(text: str) -> bool:
    """Does a place meant for a value hold a placeholder, an instruction or the mark of an unset value?"""
    blocks = ("```" in text or "<code" in text or "<pre" in text) and CODE.search(text)
    if blocks:
        text = CODE.sub(" ", text)
    marks = list(STRONG.finditer(text)) if any(x in text for x in SIGNS_STRONG) else []
    if any(x in text for x in SIGNS_WEAK):
        marks += [m for m in WEAK.finditer(text) if is_field(next(g for g in m.groups() if g is not None))]
    mentioned = sum(MENTION.search(text[max(0, m.start() - 60) : m.start()]) is not None for m in marks)
    if (blocks or mentioned >= 2) and TUTORIAL.search(text):
        return False  # text about templates: marks alone prove nothing
    if len(marks) > mentioned:
        return True
    if ("(" in text or "[" in text or "<" in text or "***" in text) and any(INSTRUCTION.search(m[1] or m[2]) for m in BRACKETED.finditer(text)):
        return True
    if any(x in text for x in SIGNS_UNSET) and UNSET.search(text):
        return True
    if any(not ADJECTIVE.search(text[max(0, m.start() - 24) : m.start()]) for m in UNDEFINED.finditer(text)):
        return True
    if "TODO" not in text:
        return False
    upper = sum(c.isupper() for c in text) > 0.6 * max(1, sum(c.isalpha() for c in text))
    return not upper and any(not LIST.search(text[max(0, m.start() - 16) : m.start()]) for m in TODO.finditer(text))


def has_phrase(low: str) -> bool:
    return any(x in low for x in FILLER_PHRASES)


def is_filler(text: str, low: str, phrase: bool) -> bool:
    """Are most words filler? Frame lines don't count. low: the text in lower case; phrase: does it hold a phrase of filler?"""
    # without any sign of filler the words needn't be counted
    plain = bare_words(low)
    known = set(plain)
    if not phrase and known.isdisjoint(SURE_BYTES) and len(known) > 0.2 * len(plain) and (len(known) > len(plain) - 2 or not any(a == b == c for a, b, c in zip(plain, plain[1:], plain[2:]))):
        return False
    total = filler = sure = 0
    seen: dict[str, int] = {}
    for s in SENTENCE.split(NAV.sub("\n", text)):
        if not s.strip() or FRAME.search(s):
            continue
        words = [w.lower() for w in WORD.findall(s)]
        total += len(words)
        if has_phrase(s.lower()):
            filler += len(words)
            sure += len(words)
        else:
            filler += sum(w in FILLER_WORDS or w.isdigit() for w in words)
            sure += sum(w in SURE_FILLER for w in words)
            again = sum(len(WORD.findall(m[0])) for m in AGAIN.finditer(s))
            filler += again
            sure += again
        for w in words:
            seen[w] = seen.get(w, 0) + 1
    if total == 0:
        return False
    if total >= 6 and len(seen) <= max(2, 0.12 * total):
        return True
    return sure > 0 and filler >= FILLER_SHARE * total


def is_error_body(text: str) -> bool:
    """Is the text one JSON object with an error, and next to nothing besides it and short fields?"""
    try:
        body = json.loads(text)
    except (ValueError, RecursionError):
        return False
    if not isinstance(body, dict):
        return False
    wrong = [k for k, v in body.items() if ERROR_FIELD.fullmatch(k) and v not in NO_ERROR or k.lower() == "status" and regex.match(r"[45]\d\d|error|fail", str(v), regex.I)]
    if not wrong:
        return False
    words = {k: len(WORD.findall(json.dumps(v, ensure_ascii=False))) for k, v in body.items()}
    # the message of an error is its own
    rest = sum(n for k, n in words.items() if n > FIELD_WORDS and k not in wrong and not (k.lower() in ("message", "detail", "details") and ERROR.search(str(body[k]))))
    return rest <= max(PAGE_REST, PAGE_SHARE * sum(words.values()))


def segments(text: str) -> Iterator[str]:
    """The text in parts of SEGMENT characters or more that end with a sentence or line."""
    at = 0
    while len(text) - at > 2 * SEGMENT and (m := SENTENCE.search(text, at + SEGMENT)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def pieces(text: str) -> Iterator[str]:
    """The sentences and lines of a text without navigation, sentences of many words by clauses."""
    for s in (s for x in segments(text) for s in SENTENCE.split(NAV.sub("\n", x))):
        if len(s) > 2 * MESSAGE_WORDS and not s.lstrip().startswith("{") and len(WORD.findall(s)) > MESSAGE_WORDS:
            yield from CLAUSE.split(s)
        else:
            yield s


def is_page(text: str, stem: bool) -> bool:
    """Is the text, of any length, an error message or a notice, with next to nothing else? stem: does it hold one of STEMS?"""
    if text.startswith("{") and text.rstrip().endswith("}") and is_error_body(text):
        return True
    if not stem:
        return False
    # words are parted by what is no letter or digit, so there can't be more; what lies beyond ASCII counts as such here
    most = 1 + len(text.encode("utf-8", "replace").translate(None, NO_SEPARATOR))
    message = rest = left = 0
    after = False
    for s in pieces(text):
        if rest > max(PAGE_REST, PAGE_SHARE * most):
            return False
        words = len(WORD.findall(s))
        left += words
        code, after = after, CODE_AFTER.search(s) is not None
        said = s if s.lstrip().startswith("{") else QUOTED.sub(" ", s)  # what is only quoted is no message
        if ERROR.search(said) or NOTICE.search(said):
            message += 1
            if words > MESSAGE_WORDS:
                rest += max(0, words - MESSAGE_WORDS * (len(ERROR.findall(said)) + len(NOTICE.findall(said))))
        elif not (code or FRAME.search(s)):
            rest += words
    return message > 0 and rest <= max(PAGE_REST, PAGE_SHARE * left)


def kind_of(text: str | None) -> str | None:
    """place, filler, page, or null for a text that is none; null, empty and blank texts are none."""
    if text is None or not text.strip():
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
        text = text.replace("’", "'")
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n")
    if has_place(text):
        return "place"
    low = text.lower()
    stem, phrase = signs(low)
    if is_filler(text, low, phrase):
        return "filler"
    return "page" if is_page(text, stem) else None


def residue(docs: DataFrame) -> DataFrame:
    """(doc_id, kind): the residue among docs (doc_id, text), one row for each row; rows of one text give the same kind.

    Null, empty and blank texts are no residue; texts of any length are looked at whole; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            kinds = pa.array([kind_of(t) for t in b.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), kinds], ["doc_id", "kind"]).filter(kinds.is_valid())

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string")


def clean(docs: DataFrame) -> DataFrame:
    """docs without the residue; rows with a null doc_id stay."""
    return docs.join(residue(docs).select("doc_id").distinct(), "doc_id", "left_anti")
