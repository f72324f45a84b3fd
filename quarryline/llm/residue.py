"""Template residue, filler, error-page text and notices that scripts are required.

What a text quotes or shows as code (quotation marks, backticks) is taken out first. The rest falls into
segments (lines, and sentences in them). A multi-pattern automaton finds the known phrases and words of a dozen
languages in each; a segment is residue if phrases that can't stand in real prose alone cover most of it, or if
words that only together say such a thing (a page and that it isn't there, scripts and that they are wanted)
leave next to nothing uncovered.
Of a long segment (a page on one line) that isn't residue as a whole, overlapping windows are judged so.
Unfilled slots and filler words have no fixed wording and are found by their form. A document is reported
if any segment is residue, with the part of it that is, so that a caller may exclude whole documents from
some coverage on.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import eq

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.common import spread
from quarryline.llm.lookalike import adopt, confusables, fold_long
from quarryline.llm.phrases import wordings

# Phrases by kind, lower case, '#' for a number. 'error' and 'filler' are residue by
# themselves, 'around' only beside them. 'notice' needs a word of 'script' in the same segment; 'rest'
# is what such notices go on with.
PHRASES = {
    "error": """
        page not found|# not found|not found|# forbidden|forbidden|# bad gateway|bad gateway|# gateway timeout|gateway timeout|# internal server error|internal server error|# service unavailable|service unavailable|service temporarily unavailable|# unauthorized|# too many requests|too many requests|error #|http error #|status #|access denied|permission denied|session expired|something went wrong|not authorised|not authorized|oops|
        the page you asked for could not be found|the page you requested could not be found|the page you are looking for does not exist|this page does not exist|this page is no longer available|the server did not answer in time|the server is not responding|this link has expired or was removed|you do not have permission to view this address|you do not have permission to access this page|an unexpected problem stopped this request|an unexpected error occurred|confirm that you are not a robot to go on|verify that you are human|we have limited requests from your network|your session has ended|your session has expired|the service is down for maintenance|we are down for maintenance|this site can't be reached|
        seite nicht gefunden|fehler #|zugriff verweigert|sitzung abgelaufen|dienst gestört|dienst nicht verfügbar|nicht berechtigt|zu viele anfragen|zeitüberschreitung|hoppla|die angeforderte seite gibt es nicht mehr|die angeforderte seite wurde nicht gefunden|der server antwortet nicht|wegen wartung ist der dienst nicht erreichbar|es ist ein unerwarteter fehler aufgetreten|sie haben für diese adresse keine rechte|ihre sitzung ist abgelaufen|bestätigen sie, dass sie kein roboter sind|etwas ist schiefgelaufen|
        page introuvable|erreur #|accès refusé|session expirée|service indisponible|service interrompu|trop de requêtes|non autorisé|délai dépassé|oups|la page demandée n'existe plus|le serveur ne répond pas|une erreur inattendue est survenue|vous n'avez pas accès à cette adresse|votre session a expiré|le service est en maintenance|confirmez que vous n'êtes pas un robot|
        página no encontrada|acceso denegado|sesión caducada|servicio no disponible|servicio interrumpido|demasiadas solicitudes|no autorizado|tiempo de espera agotado|la página solicitada ya no existe|el servidor no responde|se produjo un error inesperado|no tiene permiso para ver esta dirección|su sesión ha caducado|el servicio está en mantenimiento|confirme que no es un robot
    """,
    "around": """
        return home|help|home|contact the administrator|contact support|go back to the start page|go back|reference no. #|reference no #|reference #|request id: #|request id #|try again in a few minutes|try again later|please try again later|please try again|sign in again|log in again|reload|
        zurück zur startseite|vorgang #|bitte neu anmelden|bitte später erneut versuchen|bitte versuchen sie es später erneut|hilfe|
        retour à l'accueil|veuillez réessayer plus tard|référence #|reconnectez-vous|aide|
        volver al inicio|inténtelo más tarde|referencia #|inicie sesión de nuevo|ayuda
    """,
    "filler": """
        sample heading|your text goes here|your heading here|replace this paragraph with your own words|click to edit this block|a short description will appear here|body copy|this is dummy copy for the layout|this is dummy text|dummy copy|dummy text|placeholder text|this is placeholder text|lorem ipsum|add your text here|
        mustertext|dies ist ein blindtext|hier steht später der text|überschrift ersetzen|bitte diesen absatz austauschen|platzhaltertext|
        votre texte ici|ceci est un faux texte|titre à remplacer|paragraphe provisoire pour la maquette|texte de remplissage|faux texte|
        su texto aquí|este es un texto de relleno|título por cambiar|párrafo provisional para la maqueta|texto de relleno
    """,
    "notice": """
        your browser has blocked|is switched off in your browser|is disabled in your browser|this page requires|this site requires|this app requires|please enable|please activate|please turn on|you need to turn on|you need to enable|we cannot run without|it looks like|doesn't work properly without|
        ihr browser blockiert|diese seite benötigt|bitte aktivieren sie|sie müssen|ist in ihrem browser deaktiviert|
        votre navigateur bloque|cette page exige|cette page nécessite|veuillez activer|
        su navegador bloquea|esta página necesita|active|habilite|debe activar
    """,
    "script": "javascript|scripts|scripting|script|js|skripte|skript",
    "rest": """
        allow it|activate it|allow it and cookies|and cookies|to view this page|to see the file list|to continue|to proceed|before searching|and reload|and reload the page|to run this app|in your browser|is disabled|enabled|
        bitte erlauben|um die liste zu sehen|um fortzufahren|und laden sie neu|aktivieren|
        autorisez-le|autorisez-les|pour continuer|puis rechargez la page|pour voir la liste|les|
        permítalo|permítalos|para continuar|y recargue la página|para ver la lista|los
    """,
}
# Words of the usual Latin filler.
LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vitae semper porta lectus".split())
# What slots ask for, and what tells a slot from a tag.
SLOT_NAMES = frozenset("name title date time folder path file user email mail company address city phone count volume number ticket reason recipient sender subject amount price url link id value customer project version datum titel ordner nombre fecha titre dossier nom".split())
ASKING = r"insert|enter|your|add|fill|choose|select|to follow|to come|here|einf[üu]gen|eintragen|ersetzen|folgt|ausf[üu]llen|ins[ée]rer|[àa] venir|[àa] compl[ée]ter|[àa] remplacer|insertar|pendiente|por completar|rellenar|completar"
BEGINS = r"insert|enter|add|fill|choose|select|ins[ée]rer|ins[ée]rez|compl[ée]ter|remplacer|insertar|inserte|rellenar|completar"
ENDS = r"to follow|to come|einf[üu]gen|eintragen|ersetzen|ausf[üu]llen|[àa] venir|[àa] compl[ée]ter|[àa] remplacer|por completar"
HTML = frozenset("a b i u p s br hr em li ol ul td th tr h1 h2 h3 h4 h5 h6 div img pre sub sup nav svg span code body head html form font main table tbody thead style script strong button input label video audio header footer section article canvas iframe meta".split())
#: The part of a segment, in letters and digits, that phrases have to cover; and words that need each other.
COVERED, TOLD = 0.6, {"error": 0.9, "notice": 0.8, "filler": 0.85}
#: What has to be in a segment for its words to count, and which words then cover it.
TELLING = {
    "error": ((("thing", "fault"), ("outcry",)), ("thing", "fault", "outcry", "talk", "error", "around")),
    "notice": ((("script", "demand"),), ("script", "demand", "thing", "talk", "notice", "rest", "around")),
    "filler": ((("put", "piece", "place"),), ("put", "piece", "place", "talk", "filler")),
}
#: Characters of a window in a longer segment, and from one window to the next.
WINDOW, STEP = 400, 50

_CODE = re.compile(r"```.*?```|``[^\n]*?``|`[^`\n]*`|<code>.*?</code>|<pre>.*?</pre>", re.S)
_QUOTED = re.compile(r"\"[^\"\n]*\"|«[^»]*»|“[^”\n]*”|„[^“”\n]*[“”]|‹[^›\n]*›|(?<!\w)'[^'\n]{2,}'(?!\w)")
_ID = r"[A-Za-z][\w.]*"
_SLOTS = re.compile(
    rf"\{{\{{\{{?\s*+(?:[#/^&>]\s*+)?[A-Za-z][^{{}}\n]*+\}}\}}\}}?|\{{%-?\s*[A-Za-z][^{{}}\n]*%\}}|<%[=-]?\s*[A-Za-z][^<>\n]*%>|[$#]\{{\s*{_ID}\s*\}}"
    rf"|@@\s*{_ID}\s*@@|%\({_ID}\)[sdif]|\[object Object\]|\[\[\s*{_ID}\s*\]\]|<<\s*[A-Za-z][^<>\n]{{0,40}}>>|\b(?:FIXME|TODO|TBD)-[A-Z]+\b|_{{4,}}\s*\([^()\n]{{2,}}\)"
)
_MAYBE = re.compile(rf"(?<![\w{{]){{({_ID})}}(?![\w}}])|(?<!\w)%({_ID})%(?!\w)|(?<![\w$])\$({_ID})\$(?!\w)|(?<![\w_])__({_ID}?)__(?![\w_])|(?<!\[)\[([^\[\]\n]{{2,}})\](?![\](])|(?<!<)<([^<>\n/]{{2,}})>(?!>)|\b([A-Z]{{4,}}\s*\([^()\n]{{2,}}\))|<<\s*([A-Za-z][^<>\n]*)>>")
# What any slot begins with: a text without these needs no closer look.
_OPENERS = ("{{", "{%", "<%", "${", "#{", "@@", "%(", "[object", "[[", "<<", "FIXME-", "TODO-", "TBD-", "____")
_CAPS = re.compile(r"[A-Z]{4}\s*\(")
_ASKS = re.compile(rf"(?<!\w)(?:{ASKING})(?!\w)", re.I)
# A sentence in brackets may hold such words too: a longer instruction begins with what it asks or ends with it.
_INSTRUCTS = re.compile(rf"\s*(?:(?:please|bitte|veuillez|merci de|por favor),?\s+)?(?:{BEGINS})(?!\w)[^=]*|[^=]*(?<!\w)(?:{ENDS})[\s.!]*", re.I)
_SEGMENT = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\s+[-–—]\s+")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_RUN = re.compile(r"\w+")
_LIGHT = re.compile(r"[^\w#]+|_+")
# Letters of scripts that put no spaces between words.
_UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]").search
_LONG_LATIN = frozenset(w for w in LATIN if len(w) > 3)


def _is_slot(m: re.Match) -> bool:
    curly, percent, dollar, under, square, angle, caps, double = m.groups()
    if caps:
        inner = caps[caps.index("(") + 1 : -1]
        return bool(_ASKS.search(caps) if len(inner) <= 40 else _INSTRUCTS.fullmatch(inner))
    if double:  # what _SLOTS takes no longer may be a quotation
        return bool(_INSTRUCTS.fullmatch(double))
    inner = next(x for x in m.groups() if x is not None).strip()
    plain = re.fullmatch(_ID, inner)
    if not plain:
        return bool(_ASKS.search(inner) if len(inner.split()) <= 6 else _INSTRUCTS.fullmatch(inner))
    if curly or percent or dollar:
        return len(inner) > 1
    low = inner.lower()
    known = low in SLOT_NAMES or "_" in inner or "." in inner.strip(".") or inner.isupper() and len(inner) > 3
    if angle:
        return known and low not in HTML
    return known


def slots(text: str) -> list[tuple[int, int]]:
    """Where unfilled slots stand in a text without its quoted parts. A slot ends with its closing sign, in
    its line. In [..], <..>, <<..>> and after capitals, long ones are slots if they begin or end as instructions."""
    out = [m.span() for m in _SLOTS.finditer(text)] if any(o in text for o in _OPENERS) else []
    if any(o in text for o in "{%$[<") or "__" in text or _CAPS.search(text):
        out += [m.span() for m in _MAYBE.finditer(text) if _is_slot(m)]
    return out


#: Without a word of these kinds no segment is residue.
TRIGGERS = ("error", "filler", "notice", "fault", "outcry", "script", "piece")


@lru_cache(maxsize=2)
def _automaton(kinds_kept: tuple[str, ...] | None = None) -> ahocorasick.Automaton:
    """Over all phrases and words, or over those of some kinds."""
    a, listed = ahocorasick.Automaton(), {k: {" ".join(p.split()) for p in block.split("|")} for k, block in PHRASES.items()}
    for kind, phrases in [*listed.items(), *((k, {fold_long(w).casefold() for w in ws}) for k, ws in wordings().items())]:
        for p in sorted(phrases - {""}) if kinds_kept is None or kind in kinds_kept else ():
            kinds = a.get(p)[1] if p in a else ()
            if kind not in kinds:
                a.add_word(p, (len(p), (*kinds, kind)))
    a.make_automaton()
    return a


def _weight(text: str) -> int:
    return len(_LIGHT.sub("", text))


def _spread(spans: list[tuple[int, int]], text: str) -> int:
    """Letters and digits of `text` inside the spans, each once."""
    total, end = 0, 0
    for a, b in sorted(spans):
        a = max(a, end)
        if b > a:
            total += _weight(text[a:b])
            end = b
    return total


def _phrases(segment: str) -> tuple[str, dict[str, list[tuple[int, int]]]]:
    """The segment as phrases are written, and where those of each kind stand in it."""
    s = _plain(segment)
    spans: dict[str, list[tuple[int, int]]] = {}
    if any(True for _ in _hits(s, TRIGGERS)):
        for a, b, kinds in _hits(s):
            for k in kinds:
                spans.setdefault(k, []).append((a, b))
    return s, spans


def _plain(text: str) -> str:
    return " ".join(_DIGITS.sub("#", text.casefold().replace("’", "'")).split())


def _hits(s: str, kinds_kept: tuple[str, ...] | None = None) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """(start, end, kinds) of whole words and phrases."""
    for end, (n, kinds) in _automaton(kinds_kept).iter(s):
        a, b = end - n + 1, end + 1
        if not (a and s[a - 1].isalnum() and s[a].isalnum() and not _UNSPACED(s[a - 1 : a + 1])) and not (b < len(s) and s[b].isalnum() and s[b - 1].isalnum() and not _UNSPACED(s[b - 1 : b + 1])):
            yield a, b, kinds


def _kind(s: str, spans: dict[str, list[tuple[int, int]]]) -> str | None:
    weight = 0
    for kind, others in (("error", ("around",)), ("filler", ("around",)), ("notice", ("script", "rest", "around"))):
        if kind in spans and (kind != "notice" or "script" in spans):
            weight = weight or _weight(s)
            if _spread([x for k in (kind, *others) for x in spans.get(k, ())], s) >= COVERED * weight:
                return kind
    # Lines of logs and settings say such words too, about their own fields.
    for kind, (needed, covering) in TELLING.items() if "=" not in s else ():
        if any(all(k in spans for k in ks) for ks in needed):
            weight = weight or _weight(s)
            if _spread([x for k in covering for x in spans.get(k, ())], s) >= TOLD[kind] * weight:
                return kind
    return None


def segment_kind(segment: str) -> str | None:
    """error, notice or filler, if the segment is that and little else."""
    return _kind(*_phrases(segment))


def stretches(segment: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what is residue in a segment: all of it, or else its windows that are, each from
    the start of a word to the end of one."""
    s, spans = _phrases(segment)
    kind = _kind(s, spans)
    if kind:
        yield 0, len(segment), kind
    elif len(segment) > WINDOW and spans.keys() & {"error", "filler", "notice", "fault", "outcry", "demand", "piece"}:
        runs = [m.span() for m in _RUN.finditer(segment)]
        starts, ends = [a for a, _ in runs], [b for _, b in runs]
        first, last = 0, -1
        while first < len(runs) and last < len(runs) - 1:
            a = starts[first]
            last = bisect_right(ends, a + WINDOW) - 1
            if last >= first and (kind := segment_kind(segment[a : ends[last]])):
                yield a, ends[last], kind
            first = max(first + 1, bisect_left(starts, a + STEP))


def _fillers(text: str) -> list[tuple[int, int]]:
    """Runs of five times the same word, or of four and more words of Latin filler."""
    plain = _WORD.findall(text.casefold())
    if sum(map(_LONG_LATIN.__contains__, plain)) < 3 and sum(map(eq, plain, plain[1:])) < 4:
        return []
    out, same, latin = [], [], []
    for m in _WORD.finditer(text):
        w = m[0].casefold()
        if same and same[-1][0] == w and not text[same[-1][2] : m.start()].strip(" ,\t"):
            same.append((w, m.start(), m.end()))
        else:
            if len(same) >= 5:
                out.append((same[0][1], same[-1][2]))
            same = [(w, m.start(), m.end())]
        if w in LATIN:
            latin.append((w, m.start(), m.end()))
        else:
            if len(latin) >= 4 and sum(len(x[0]) > 3 for x in latin) >= 3:
                out.append((latin[0][1], latin[-1][2]))
            latin = []
    if len(same) >= 5:
        out.append((same[0][1], same[-1][2]))
    if len(latin) >= 4 and sum(len(x[0]) > 3 for x in latin) >= 3:
        out.append((latin[0][1], latin[-1][2]))
    return out


def residue(text: str | None) -> tuple[list[str], float]:
    """(kinds found, part of the text's characters that are residue): slot, filler, error, notice."""
    if not text:
        return [], 0.0
    s = fold_long(text.replace("\r\n", "\n").replace("\r", "\n"))
    s = _QUOTED.sub(" ■■■■■■■■ ", _CODE.sub(" ■■■■■■■■ ", s))
    kinds, spans = set(), []
    for name, found in (("slot", slots(s)), ("filler", _fillers(s))):
        if found:
            kinds.add(name)
            spans += found
    for line in _SEGMENT.finditer(s):
        if not any(True for _ in _hits(_plain(line[0]), TRIGGERS)):
            continue
        at = line.start()
        for part in _SENTENCE.split(line[0]):
            a = s.find(part, at)
            at = a + len(part)
            for b, c, kind in stretches(part.replace("■", "x")):
                kinds.add(kind)
                spans.append((a + b, a + c))
    if not kinds:
        return [], 0.0
    size = _weight(s)
    return sorted(kinds), min(1.0, _spread(spans, s) / size) if size else 1.0


def _scan(shapes: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adopt(shapes)
        for b in batches:
            ids, kinds, parts = [], [], []
            for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                k, part = residue(t)
                if k:
                    ids.append(d)
                    kinds.append(",".join(k))
                    parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(parts, pa.float64())], ["doc_id", "kinds", "coverage"])

    return run


def residue_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kinds, coverage) of documents with residue. Null and empty texts have none. A repeated row
    is reported again. No shuffle: each document is looked at where it is read."""
    return spread(documents).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan(confusables(documents.sparkSession)), "doc_id bigint, kinds string, coverage double")
