"""Template residue, filler, error pages and script notices in place of content."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import join_checked
from tidemark.session import ship, written

# Rules on whole texts: plain strings, one of which stands in any match, the pattern, and what takes its place.
# What is only shown or quoted: fenced and indented code, code in backticks, quoted lines, words in quotation marks; and tags.
_SHOWN = (
    (("```", "~~~"), r"(?s)(```|~~~).*?(\1|\z)", "\n"),
    (("    ", "\t"), r"(?m)^(?: {4}|\t).*$", " "),
    (("`",), r"(?s)``.+?``|`[^`]*`", " "),
    ((">",), r"(?m)^\s*>(?!>).*$", " "),
    (("\"", "“", "„", "«", "‹"), r"\"[^\"\n]*+\"|“[^”\n]*+”|„[^“”\n]*+[“”]|«\s[^»\n]*+\s»|‹[^›\n]*+›", " "),
    (("<",), r"</?[a-zA-Z][a-zA-Z0-9]*(?: [^<>\n]*=[^<>\n]*)?/?>", " "),
)
#: Where a message ends: with its line or sentence.
_ENDS = r"\n|(?<=[.!?])\s+"
#: A line break within a paragraph, before a line that isn't an item of a list.
_WRAPS = r"(?<!\n) ?\n ?(?! ?(?:\n|[-*+•#|>]|<num>[.)]))"
# A placeholder within an address, in lower case; not its percent signs, and brackets only where a part of it begins.
_PLAIN = r"\p{L}[\w\p{L}]*(?:[ ._-][\w\p{L}]+){0,3}"
_FILLED = (
    rf"\{{\{{[^{{}}\n]{{0,80}}\}}\}}|\{{%[^\n]{{0,80}}?%\}}|<%[^\n]{{0,80}}?%>|[$#]\{{\s*{_PLAIN}\s*\}}|%\({_PLAIN}\)[sdifr]|\[\[\s*{_PLAIN}\s*\]\]|\(\(\(\s*{_PLAIN}\s*\)\)\)|@@{_PLAIN}@@"
    rf"|(?<!\w)__{_PLAIN}__(?!\w)|<(?:your|insert|enter) [^<>\n]{{1,40}}>|«{_PLAIN}»|(?<![\w$])\${_PLAIN}\$(?![\w$])|(?<![\w%])%{_PLAIN}%(?![\w%])|(?<![\w$#{{%\]])\{{\s*{_PLAIN}\s*\}}(?!\}})|(?<=[/.=])\[{_PLAIN}\](?![\](:\[])"
)
_PAST = rf"(?:(?!(?=[{{<$#%\[(@_«])(?:{_FILLED}))\S)++"  # possessive: long addresses need no stack
# What differs between copies of the same message; every digit is 0 and every space " " by then. Addresses end where a placeholder begins.
_MASKS = (
    (("://", "www."), rf"(?:https?|ftp)://{_PAST}|www\.{_PAST}", "<addr>"),
    (("@",), r"\b(?!__)\w*+(?:[.+-](?!__)\w*+)*+@(?!__)[\w-]+\.(?!__)[\w.]+\b", "<addr>"),
    ((".0.", ".00.", ".000."), r"\b0{1,3}(?:\.0{1,3}){3}\b", "<addr>"),
    (("0000-00-00",), r"\b0000-00-00(?:[t ]00:00(?::00)?)?\b", "<date>"),
    ((".0.", ".00.", "/0/", "/00/"), r"\b0{1,2}[./]0{1,2}[./]0{2,4}\b", "<date>"),
    (("0:00",), r"\b0{1,2}:00(?::00)?\b", "<date>"),
    (("0",), r"\b(?=[a-f]*+0)(?=0*+[a-f])[0a-f]{6,}+\b", "<id>"),
    (("0",), "0++", "<num>"),
    (("  ",), "  ++", " "),
)
_LIKE = ("123456789\t\r\f\x0b\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u3000", "0" * 9 + " " * 18)

#: A message is widely recurring if its normal form stands so often, in more than one source.
RECUR = 3
#: Notices that are looked for within longer messages at a time, and their bytes; and the least length of one that is, or of what is left of one that was cut off.
NOTICES, NOTICE_BYTES, LEAST = 50_000, 16_000_000, 15

_NAME = r"[^\W\d_]\w*(?:[ ._-]\w+){0,3}"
# A name with masks; single brackets, guillemets and dollars also hold references, quotations and formulas ("[note 1]", "$x_1$"), so that marks must be glued there.
_MASK = r"<(?:num|id|date)>"
_MARKED = rf"(?:[^\W\d_]|<id>)(?:\w|{_MASK})*(?:[ ._-](?:\w|{_MASK})+){{0,3}}"
_GLUED = rf"[^\W\d_]{{3}}(?:\w|<num>)*(?:[._-](?:\w|<num>)+){{0,3}}"
_OPEN = re.compile(
    rf"\{{\{{[^{{}}\n]{{0,80}}\}}\}}|\{{%[^\n]{{0,80}}?%\}}|<%[^\n]{{0,80}}?%>|[$#]\{{\s*{_MARKED}\s*\}}|%\({_MARKED}\)[sdifr]|\[\[\s*{_MARKED}\s*\]\]|\(\(\(\s*{_MARKED}\s*\)\)\)"
    rf"|@@{_MARKED}@@|(?<!\w)__(?!init__|main__|name__|file__){_MARKED}?__(?!\w)|<(?:your|insert|enter) [^<>\n]{{1,40}}>|\[(?:your|insert|enter|add) [^\[\]\n]{{1,40}}\]|«(?:{_NAME}|{_GLUED})»|(?<![\w$])\$(?:{_NAME}|{_GLUED})\$(?![\w$])|(?<![\w%])%%?{_MARKED}%%?(?![\w%])|<(?:\w+ ){{1,3}}(?:name|date|e-?mail|address|company|title|number|id|amount|city|phone|link|url)>",
    re.I,
)
_LOOSE = re.compile(rf"(?<![\w$#{{%\]])\{{\s*{_MARKED}\s*\}}(?!\}})|(?<![\w\[!])\[{_NAME}\](?![\](:\[])", re.I)
_FAILED = re.compile(r"\[object \w+\]|\binvalid date\b|\(no value\)|\(null\)|#(?:ref|value|name|div/<num>)[!?]|\bnan (?:second|minute|hour|day|week|month|year)s?\b|<no value>", re.I)
_FAILED_HAVE = ("[object", "invalid date", "(no value)", "(null)", "#", "nan ", "<no value>")  # one of which stands in whatever the pattern matches
_VOID_HAVE = ("undefined", "null", "none", "nan", "nil")
_VOID = re.compile(r"(?<![\w.`])(?:undefined|null|none|nan|nil)(?![\w`])", re.I)

# Words of the usual dummy text, keys of a keyboard in rows, and nonsense words.
_DUMMY_WORDS = frozenset("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
_DUMMY_SHORT = frozenset("do in ad et ut ex ea eu id est non sit sed esse qui sunt".split())
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm")
_KEYS = frozenset(r[i : i + 3] for row in _ROWS for r in (row, row[::-1]) for i in range(len(row) - 2))
_NONSENSE = frozenset("blah bla yada foo bar baz test abc abcd xyz".split())
_FILLER_PHRASE = re.compile(r"dummy|placeholder|filler|sample|copy|coming soon|tbd|test post|replaced|write your|type your|goes here|blindtext|platzhalter|fülltext|aquí va|relleno|provisoire|steht|texto")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"<num>|[^\W_]+")

# Phrases of widely recurring messages that stand in for content; in lower case, with masks for numbers, dates and identifiers.
_PHRASES = re.compile(
    "|".join((
        # filler
        r"\b(?:dummy|placeholder|filler|sample|example) (?:paragraph|content|copy|answer body|question title|body)\b|\bsample (?:text|summary|author|title|answer|question|code|product|version|team|signature|post)\b|\bbody copy body copy\b|\b(?:text|content|description|title) (?:goes|comes|to go) here\b|\b(?:content|text|page|more) coming soon\b|\bcoming soon\b\W*$|(?:\btbd\b\W*){3,}|\btest post\W+please ignore\b|\bplaceholder, to be (?:replaced|filled)|\bto be replaced before (?:launch|release|publication)\b|\bwrite your (?:answer|question|text|post|comment) (?:in this field|here)\b|\btype your (?:answer|question|text|post|comment) here\b",
        r"\bhier (?:steht|kommt|folgt) (?:später|bald|demnächst)|\bblindtext\b|\bplatzhalter(?:text)?\b(?= für|\W*$)|\bfülltext\b|\baquí va el (?:contenido|texto)\b|\btexto de (?:relleno|ejemplo|prueba)\b|\btexte (?:provisoire|de remplissage|d'exemple)\b|\bfaux texte\b",
        # scripts, cookies, another browser
        r"\b(?:enable|activate|allow|turn on|switch on|activer|activez|aktivieren|activa|active|habilite|habilita|autorisez)\b(?: (?:sie|bitte|your|the|le|les|el|los|cookies|and|und|y|et|java ?script|scripts?)){0,4} ?\b(?:java ?script|scripts?|skripte|cookies?|js)\b(?! (?:was|were|is|are|which|inside|from|in))",
        r"\b(?:java ?script|scripts?|skripte|js|cookies?)\b(?: and (?:cookies|scripts))? (?:must|need to|have to|has to|müssen|muss|deben?|doivent|doit) (?:be )?(?:allowed|enabled|activated|turned on|switched on|aktiviert|erlaubt|zugelassen|estar|être)",
        r"\b(?:requires?|needs?|benötigt|braucht|necesita|requiere|nécessite)\b (?:java ?script|scripts? to run|skripte|js|cookies)\b|\bbrowser (?:is|was) (?:not|no longer) supported\b|\b(?:has|have) (?:them|java ?script|scripts|cookies) (?:switched|turned) off\b|\bnavegador no (?:permite|admite|es compatible)|\bnavigateur n'est pas (?:pris en charge|compatible)|\bbrowser wird nicht (?:mehr )?unterstützt|^\W*noscript:|\bnot a robot\b.{0,40}\bscripts?\b|\bcontent blocker, then reload\b|\bswitch to a newer (?:one|browser|version) to see\b|\bthis (?:site|page|app|application) (?:works best|needs scripts)",
        # a site or server speaking
        r"\bthe requested (?:page|url|resource|document) (?:does not exist|was not found|could not be found|cannot be found)|\b(?:page|seite|página) (?:was )?(?:introuvable|not found|no encontrada|nicht gefunden)\b|\bdiese seite wurde nicht gefunden\b|\bwe cannot find what you were\b|\bthat (?:thread|page|question|post) is gone\b|\bthis (?:question|post|thread|answer|page|topic) (?:was|has been) (?:removed|deleted|locked|moved) (?:for|by|and|due)\b.{0,60}|\bcan no longer be shown\b|\bunable to (?:load|display|show) this (?:answer|page|question|post|thread|content)\b",
        r"\baccess to this (?:resource|page|site|server) is (?:forbidden|denied|restricted|blocked)\b|\bacc(?:ès|eso) (?:refusé|denegado|interdit)\b|\bzugriff (?:verweigert|verboten)\b|\btoo many requests\b|\bplease (?:sign|log) in again\b|\byour session (?:has )?(?:expired|timed out)\b|\bsomething went wrong(?: on our side)?\b|\bservice is (?:down|unavailable)\b|\bdown for maintenance\b|\bha ocurrido un error (?:interno|inesperado)\b|\bune erreur (?:interne|inattendue|est survenue)|\bein (?:interner|unerwarteter) fehler\b|\bserver ist (?:gerade |derzeit |zur zeit )?(?:überlastet|nicht erreichbar)|\bbitte später (?:erneut|noch einmal|wieder)",
        r"\berror <num>: |\bhttp <num> / |^\W*<num> (?:-|–|:) (?:the |page|not|bad|internal|service|gateway|forbidden)|\bupstream did not answer\b|\bthe database is not available\b|\btemplate engine (?:out of|failed|error)|\bfatal: .{0,60} on line <num>|\bservidor no (?:está )?disponible\b|\bserveur (?:indisponible|surchargé)\b|\bservice (?:temporarily )?unavailable\b|\bbad gateway\b|\binternal server error\b|\bgateway time-?out\b",
    ))
)
# People write these words too: only a message that says nothing else is a site's.
_PERHAPS = re.compile(
    r"\W*(?:error\W*)?(?:<num>\W*)?(?:(?:page |file |object )?not found|(?:access |permission )?(?:is |was )?denied|forbidden|unauthorized|service unavailable|under maintenance|not available|(?:please )?(?:wait|try again)(?: later| <num> \w+| in <num> \w+)?|loading|redirecting|please wait)(?:\W*<num>)?\W*"
)
_ABOUT = re.compile(r"\b(?:how|why|does anyone|what is|what does|which|cómo|wie kann|comment)\b[^.?!]*\?")


#: What a site, a server or a script says of itself, in general: a thing of theirs, and its state. Only for short messages that recur, without a word of somebody's own.
_THINGS = re.compile(
    r"\b(?:pages?|sites?|websites?|web ?pages?|links?|urls?|domains?|servers?|services?|requests?|connections?|accounts?|sessions?|access|gateways?|resources?|rate limits?|browsers?|networks?|files?|content|captcha|quota|login|verification"
    r"|seiten?|webseiten?|dienst|anfragen?|verbindung|konto|sitzung|zugriff|zugang|página|páginas|sitio|servidor|servicio|conexión|cuenta|sesión|acceso|solicitud|serveur|connexion|compte|accès|requête"
    r"|pagina|sito|servizio|connessione|accesso|sessione|richiesta|serviço|conexão|conta|sessão|acesso|pedido|toegang|verbinding|pagina's)\b"
)
_STATES = re.compile(
    r"\b(?:not (?:be )?(?:found|available|exist|reachable|supported|permitted|allowed)|does(?: not|n't) exist|no longer (?:exists?|available)|timed out|time-?out|exceeded|suspended|disabled|deactivated|expired|blocked|banned|denied|forbidden|refused|unavailable|unreachable|offline|overloaded|down for|for sale|broken|redirect(?:ed|ing)|being (?:checked|verified)|checking|verifying|moved permanently"
    r"|nicht (?:gefunden|verfügbar|erreichbar|erlaubt|gestattet)|abgelaufen|gesperrt|verweigert|überlastet|deaktiviert|no (?:encontrad[ao]|disponible|existe|permitido)|no se (?:ha )?(?:encontr\w+|pudo)|caducad[ao]|expirad[ao]|bloquead[ao]|denegad[ao]|suspendid[ao]|introuvable|indisponible|expirée?|refusée?|bloquée?|suspendue?|interdite?|n'existe (?:pas|plus)"
    r"|non (?:è stata )?(?:trovat[ao]|disponibile)|scadut[ao]|negat[ao]|bloccat[ao]|sospes[ao]|não (?:foi )?(?:encontrad[ao]|disponível|existe)|negado|suspens[ao]|niet (?:gevonden|beschikbaar)|geweigerd|verlopen)\b"
)
#: The same of scripts and browsers, and what is asked for; of errors, and where they were; of what can't be shown, and what it is; and requests to sign in or come back.
_PAIRS = (
    (
        re.compile(r"\b(?:java ?script|scripts?|js|cookies?|skripte|ad ?-?block\w*|content blockers?|browsers?|navegador|navigateur|navegador|captcha|robots?)\b"),
        re.compile(
            r"\b(?:enabled?|activated?|allow(?:ed)?|turn(?:ed)? (?:it |them )?(?:on|off)|switch(?:ed)? (?:on|off|to)|requires?|required|needs?|disabled?|reload|updated?|upgrade|outdated|supported|aktivier\w*|benötig\w*|erlaub\w*|zulassen|einschalten|unterstützt\w*|activ[aeo]\w*|habilit\w*|permit\w*|permet\w*|necesit\w*|requier\w*|autoris\w*|nécessit\w*|compatib\w*|attiva\w*|abilita\w*|richied\w*|ativ[ae]\w*|inschakel\w*|nodig)\b"
        ),
    ),
    (
        re.compile(r"\b(?:errors?|http|fehler|erreur|errore|erro|fatal|exception|went wrong|schief(?:gelaufen|gegangen)|salió mal)\b"),
        re.compile(r"^\W*(?:error|http|fehler|erreur|errore?|erro|code|status)\W*<num\b|\b(?:servers?|pages?|sites?|templates?|databases?|upstream|gateway|requests?|internal|interne?r?|interno|unexpected|unerwartet\w*|inattendue?|inesperad[ao]|inattes[ao]|occurred|aufgetreten|ocurrid[ao]|survenue?|out of memory|our (?:side|end))\b"),
    ),
    (
        re.compile(r"\b(?:pages?|threads?|answers?|questions?|discussions?|posts?|topics?|content|databases?|services?|articles?|comments?|what you (?:were|are) looking for|seiten?|beitr\w+|antwort\w*|frage|inhalt|respuestas?|preguntas?|contenido|réponses?|questions|contenu|article|risposta|contenuto|resposta|conteúdo)\b"),
        re.compile(
            r"\b(?:not available|down|maintenance|(?:cannot|can't|could not|can no longer) (?:be )?(?:shown|displayed|found|find|loaded|load|opened)|unable to (?:load|display|show|find|open)|cannot find|is gone|(?:was|were|has been|have been) (?:removed|deleted|locked|closed|archived)|wartung|nicht (?:angezeigt|geladen)|gelöscht|entfernt|no se puede mostrar|eliminad[ao]|mantenimiento|ne peut (?:pas|plus) être|supprimée?|maintenance|manutenzione|rimoss[ao]|manutenção|removid[ao])\b"
        ),
    ),
    (
        re.compile(r"\b(?:please|bitte|por favor|veuillez|prego|again|erneut|noch einmal|de nuevo|à nouveau|di nuovo|novamente|too many|zu viele|demasiad[ao]s|trop de|troppe|muit[ao]s)\b"),
        re.compile(r"\b(?:(?:sign|log) ?in|try again|wait|come back|requests?|attempts?|anmelden|einloggen|versuchen|anfragen|inici\w* sesión|inténtel\w*|solicitudes|connecte\w*|réessay\w*|requêtes|accedi|riprov\w*|richieste|tente|entrar|pedidos|session|sitzung|sesión)\b"),
    ),
)
#: Words of somebody's own, or of somebody who explains: what has them isn't a site speaking.
_OWN = re.compile(
    r"\b(?:i|i'm|i've|me|my|mine|he|she|they|them|until(?! <)|because|since|when(?:ever)?|if|unless|although|though|but|so|then|sorry|thanks?|works?|worked|fix(?:ed)?|look|use|used|case|same|only|still|once|instead|ich|mein\w*|mir|wenn|weil|aber|dann|bis|yo|mi|me|porque|pero|cuando|si|hasta|je|mon|ma|mes|parce|mais|quand|donc|jusqu\w*|io|mio|perché|eu|meu)\b|\?|:\s*$"
)
_FIRST = re.compile(r"\b(?:i|i'm|i've|my|me|ich|mein\w*|mir|yo|je|mon|moi)\b")
#: Longest message, in words, that these general rules are for.
_SHORT = 14
_SIGNS = re.compile(r"[{\[%$@_«]|\(\(\(|<(?!num>|addr>|date>|id>)")
_EDGES = " \t\u200b.,;:!*#>|»›•·…-–—"


def _where(text: Column, signs: tuple[str, ...], pattern: str, to: str) -> Column:
    """Replaces a pattern where one of the signs stands that any match has: most texts are passed on after a search for plain strings."""
    there = F.lit(False)
    for sign in signs:
        there = there | F.contains(text, F.lit(sign))
    return F.when(there, F.regexp_replace(text, pattern, to)).otherwise(text)


def _steps(df: DataFrame, column: str, rules: tuple) -> DataFrame:
    """Rules one after the other, each on a column of its own, so that a rule's text is made once."""
    for signs, pattern, to in rules:
        df = df.withColumn(column, _where(F.col(column), signs, pattern, to))
    return df


def bare(df: DataFrame, column: str) -> DataFrame:
    """`df` with the prose of a text column: without what it only shows or quotes; in lower case; with numbers, dates, addresses and
    identifiers masked and white space within lines evened out. Null counts as empty."""
    out = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("")))
    out = _steps(out, column, _SHOWN)
    out = out.withColumn(column, F.translate(F.lower(column), *_LIKE))
    return _steps(out, column, _MASKS)


def _mash(word: str) -> bool:
    return word in _NONSENSE or len(word) >= 3 and (len(set(word)) == 1 or word[:3] in _KEYS and any(word in row or word in row[::-1] for row in _ROWS))


def shape_of(message: str) -> str:
    """The normal form by which messages are grouped: "<open>" for an open placeholder in it, "<failed>" for values that failed to render, "<dummy>" and
    "<mash>" for dummy text and keyboard mash, which differ in each copy; else the message without the marks at its ends."""
    if _SIGNS.search(message) and (_OPEN.search(message) or _LOOSE.search(message)):
        return "<open>"
    if any(w in message for w in _FAILED_HAVE) and _FAILED.search(message) or any(w in message for w in _VOID_HAVE) and len(_VOID.findall(message)) >= 2:
        return "<failed>"
    tokens = _TOKEN.findall(message)
    dummy = [w for w in tokens if w in _DUMMY_WORDS]
    if len(dummy) >= 3 and 2 * len(dummy) >= len(tokens) - tokens.count("<num>"):
        words = _WORD.findall(message)
        if 2 * len(dummy) >= len(words) and sum(w not in _DUMMY_SHORT for w in dummy) >= 2:
            return "<dummy>"
    if any(w[:3] in _KEYS or w in _NONSENSE or w[:1] * 3 == w[:3] for w in tokens):
        mash = [w != "<num>" and _mash(w) for w in tokens]
        run = keys = 0
        for w, m in zip(tokens, mash, strict=True):
            if not (w == "<num>" and run or m):
                run = keys = 0
                continue
            run, keys = run + 1, keys + (w != "<num>" and w not in _NONSENSE)
            if run >= 4 and keys >= 2 or run == len(tokens) >= 2 and keys:
                return "<mash>"
        if len(tokens) >= 4 and all(w == "<num>" or w in _NONSENSE for w in tokens) and sum(w != "<num>" for w in tokens) >= 2:
            return "<mash>"
        if len(tokens) == 1 and len(tokens[0]) >= 4 and mash[0] and tokens[0] not in _NONSENSE:
            return "<mash>"
    if len(tokens) >= 5 and len(set(tokens)) <= 3 and max(map(len, tokens)) <= 5:
        return "<mash>"
    return message.strip(_EDGES)


_CLASSES = {"<open>": "template", "<failed>": "template", "<dummy>": "filler", "<mash>": "filler"}


def _general(shape: str) -> bool:
    """Whether a short message without words of somebody's own says of a thing of a site's or a script's how it is, or what is to be done."""
    return len(_WORD.findall(shape)) <= _SHORT and any(a.search(shape) and b.search(shape) for a, b in ((_THINGS, _STATES), *_PAIRS)) and not _OWN.search(shape)


def kind_of(shape: str) -> str | None:
    """The kind of a widely recurring message, given by its normal form: "template", "filler", "notice" (a site, server or script speaks), or None."""
    if shape in _CLASSES:
        return _CLASSES[shape]
    m = _PHRASES.search(shape)
    if m and not _ABOUT.search(shape) and not shape.endswith("?") and not _FIRST.search(shape):
        return "filler" if _FILLER_PHRASE.search(m.group(0)) else "notice"
    if _PERHAPS.fullmatch(shape):
        return "notice"
    return "notice" if _general(shape) else None


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([shape_of(m) for m in b.column("msg").to_pylist()], pa.string())], [*b.schema.names, "shape"])


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds = pa.array([kind_of(m) for m in b.column("shape").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("shape"), kinds], ["shape", "kind"]).filter(kinds.is_valid())


class _Finder:
    """Known notices within longer messages: whole, between the ends of words and beside no words of somebody's own; or as far as they go where the message was cut off."""

    def __init__(self, notices: dict[str, str]) -> None:
        import ahocorasick

        self.kinds = notices
        self.known = sorted(n for n in notices if len(n) >= LEAST and " " in n)
        self.machine = ahocorasick.Automaton()
        for n in self.known:
            self.machine.add_word(n, n)
        if self.known:
            self.machine.make_automaton()

    def find(self, message: str) -> str | None:
        if message in self.kinds:
            return self.kinds[message]
        if not self.known or len(message) < LEAST:
            return None
        for end, n in self.machine.iter(message):
            before, after = message[end - len(n) : end - len(n) + 1] if end >= len(n) else "", message[end + 1 : end + 2]
            if not (before.isalnum() or after.isalnum() or _OWN.search(message[: end - len(n) + 1]) or _OWN.search(message[end + 1 :])):
                return self.kinds[n]
        at = 0
        while 0 <= at <= len(message) - LEAST:
            rest = message[at:]
            i = bisect_left(self.known, rest)
            if i < len(self.known) and self.known[i].startswith(rest) and 2 * len(rest) >= len(self.known[i]):
                return self.kinds[self.known[i]]
            at = message.find(" ", at) + 1 or -1
        return None


def _spoken(shapes: DataFrame, notices: DataFrame) -> DataFrame:
    """(h, kind): messages that are or hold a known one. The notices go to the tasks NOTICES or NOTICE_BYTES at a time, so that any number of them can be looked for."""
    n, size = notices.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("shape")), F.lit(0))).first()
    parts = max(-(-n // NOTICES), -(-size // NOTICE_BYTES))
    found = shapes.where("shape = '<open>'").select("h", F.lit("template").alias("kind"))
    notices = notices.withColumn("_p", F.pmod(F.xxhash64("shape"), F.lit(parts))) if parts > 1 else notices.withColumn("_p", F.lit(0))
    for part in range(parts):
        held = shapes.sparkSession.sparkContext.broadcast({r["shape"]: r["kind"] for r in notices.where(F.col("_p") == part).collect()})

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            finder = _Finder(held.value)
            for b in batches:
                kinds = pa.array([finder.find(m) for m in b.column("shape").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("h"), kinds], ["h", "kind"]).filter(kinds.is_valid())

        found = found.unionByName(shapes.where("shape <> '<open>'").select("h", "shape").mapInArrow(look, "h long, kind string"))
    return found.distinct()


def residue(df: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc, kind, message): the documents that hold template residue, filler or a notice in place of content, one row for each
    document and kind, with an example (the first in byte order).

    The prose of a text, without code and quotations, falls into messages: the sentences of its lines and of its paragraphs. Messages are masked, brought to a
    normal form (`shape_of`) and grouped by it over all documents and sources. Those that recur widely, RECUR times in more than one source, are
    classified by rules for placeholders and phrases (`kind_of`). Each message that is one of these, holds it, or is what is left of it
    where a text was cut off, counts; whatever recurs nowhere doesn't, with one exception: an open placeholder is one wherever it stands.

    Null and empty texts hold nothing; a null source is a source of its own; documents with the same id are one, unless it is null.
    Texts are read to the end, whatever their length. Extra columns are ignored.
    """
    ship(df.sparkSession)
    p = bare(df.select(F.col(doc).alias("_d"), F.col(source).cast("string").alias("_s"), F.col(text).alias("_p")), "_p")
    # Lines that are short go with the line before them too: a message may stand one word to a line.
    # So do all lines of a paragraph, except items of lists: a sentence may be wrapped anywhere.
    none = F.array().cast("array<string>")
    p = p.withColumns({f"_j{i}": F.when(F.contains("_p", F.lit("\n")), F.regexp_replace("_p", j, " ")) for i, j in enumerate((r"\s*\n\s*(?=[^\n]{0,24}(?:\n|\z))", _WRAPS))})
    parts = F.concat(F.split("_p", _ENDS), *(F.when(F.col(j) != F.col("_p"), F.split(j, _ENDS)).otherwise(none) for j in ("_j0", "_j1")))
    words = p.select("_d", "_s", F.explode(F.array_distinct(F.transform(parts, F.trim))).alias("msg")).where("msg <> ''")
    words = written(words.withColumn("h", F.xxhash64("msg")), "messages")  # texts are taken apart once
    # How far each message spreads: summed before it moves, so that one in a third of all documents is one row a task. Two sources are told by the least and the greatest.
    s = F.coalesce(F.concat(F.lit("="), "_s"), F.lit(""))
    spread = words.groupBy("h", "msg").agg(F.count("*").alias("n"), F.min(s).alias("a"), F.max(s).alias("z"))
    shapes = written(spread.mapInArrow(_shapes, "h long, msg string, n long, a string, z string, shape string").drop("msg"), "shapes")
    wide = shapes.where("shape <> '' and shape <> '<open>'").groupBy("shape").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("z").alias("z")).where((F.col("n") >= RECUR) & (F.col("a") < F.col("z")))
    notices = written(wide.mapInArrow(_kinds, "shape string, kind string"), "notices")
    hits = join_checked(words.select("_d", "h", "msg"), written(_spoken(shapes, notices), "residue"), ["h"])
    return hits.groupBy(F.col("_d").alias(doc), "kind").agg(F.min("msg").alias("message"))


def without_residue(df: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """`df` without the documents in which `residue` finds something; rows with a null id are kept."""
    bad = residue(df, doc, text, source).select(doc).distinct()
    return df.join(bad, doc, "left_anti").select(*df.columns)
