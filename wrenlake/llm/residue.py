"""Template residue, filler, error pages and script notices in place of content.

Plan: pages become lines; normalised lines are counted by host over distinct texts; lines that recur on a
host next to real content are its boilerplate and are subtracted; what is left of a record is held against
rules for unfilled placeholders, filler, error messages and script notices. Everything is JVM-side:
one explode, one aggregation by (host, line), one salted join, one aggregation by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenlake.functions.text import collapse
from wrenlake.operators.skew import salted_join
from wrenlake.session import cut

# Placeholder forms of public template languages and mail-merge fields.
PLACEHOLDERS = (
    r"\{\{[^{}\n]{0,80}\}\}",  # {{ name }}
    r"\{%[^%\n]{0,80}%\}",  # {% name %}
    r"<%[^%\n]{0,80}%>",  # <%= name %>
    r"[$#]\{[^{}\n]{0,60}\}",  # ${name} #{name}
    r"\$\[[^\[\]\n]{0,60}\]",  # $[name]
    r"(?<![\w{$#])\{[0-9A-Za-z_.]{1,30}\}",  # {0} {name}
    r"%%[A-Za-z_]\w*%%",  # %%Name%%
    r"(?<![\w%])%[A-Za-z]+_\w+%(?!\w)|(?<![\w%])%[A-Z]{3,}%(?!\w)",  # %JOB_TITLE%
    r"@@\w+@@",  # @@name@@
    r"\[\[[^\[\]\n]{1,60}\]\]",  # [[name]]
    r"<<[^<>\n]{1,60}>>",  # <<NAME>>
    r"(?<!\w)__[A-Za-z][A-Za-z_]*__(?!\w)",  # __NAME__
    r"(?<![\w$])\$[A-Za-z_]{3,}\$(?!\w)",  # $NAME$
    r"(?i:\[object \w+\])",
    r"<[A-Z]+(?:[ _][A-Z]+)+>|<(?:NAME|COMPANY|CITY|TITLE|DATE|ROLE)>",  # <YOUR NAME>
    r"\[(?:[A-Z]{3,}(?:[ _][A-Z]{2,})*)\]",  # [COMPANY NAME]
    r"(?i)\[(?:insert|your|enter|add|ihre?|votre|su|tu|nom|einf[uü]gen|ins[eé]rer|insertar)\b[^\[\]\n]{0,60}\]",
    r"(?i)\[(?:company|city|name|title|role|date|location|salary|job title|firma|ort|entreprise|ville|empresa|ciudad)(?: name)?\]",
)
PLACEHOLDER = "|".join(f"(?:{p})" for p in PLACEHOLDERS)
#: a value that was never set, printed as a word; not as the adjective of something technical
UNSET = r"(?i)(?<![\w'’-])undefined(?![\w'’-])(?!\s+(?:behaviou?rs?|variables?|symbols?|references?|methods?|terms?|scope|or null|values?|propert))"
UNSET_FIELD = r"(?i)^(?:null|nan|none|nil|undefined)$"

#: talk about templates: code marks or quotes round the placeholder, or a word that introduces an example
QUOTED = r"`[^`\n]*`|[“\"‘«‹]\s*(?:" + PLACEHOLDER + r")\s*[”\"’»›]"
EXAMPLE = r"(?i)\b(?:like|such as|e\.g\.|for example|i\.e\.|called|syntax|tokens?|variables?|wie|z\. ?B\.|comme|p\. ?ex\.|como|por ejemplo)\s+(?:" + PLACEHOLDER + ")"

# Whole lines that fill a space for text to come.
FILLER = (
    r"(?:your |the |job |role |full )*(?:text|headline|title|description|content|summary|copy|bio|name)s? (?:goes|go|comes|come|here|to come)\b.{0,60}",
    r"(?:your|enter|insert|add|type|write) (?:your |a |the |job |role )*(?:text|headline|title|description|content|summary|bio|name)s?(?: here)?",
    r"(?:sample|dummy|example|placeholder|filler|test|default|demo) (?:\w+ ){0,2}(?:text|content|copy|headline|title|description|data|posting|entry)\b.{0,60}",
    r"(?:placeholder|dummy)\b.{0,50}",
    r"(?:todo|fixme|tbd|tbc|tba|xxx)\b\s*[:\-–].{0,80}",
    r"(?:(?:todo|tbd|tbc|tba|x{3,}|asdf\w*|qwer\w*|qwertz\w*|foo|bar|baz|blah?|bla|test|n/a|lorem|ipsum|aaa+|abc|123)[\s.,;:!/–-]*)+",
    r"texte? (?:à|a) (?:compl[eé]ter|venir|remplacer|d[eé]finir)\b.{0,40}",
    r"(?:votre|ins[eé]rez|saisissez|entrez) (?:votre |le |un )?(?:texte|titre|description|contenu)(?: ici)?\b.{0,30}",
    r"(?:exemple de|faux) texte\b.{0,40}|texte (?:d['’]exemple|de remplissage|provisoire)\b.{0,40}",
    r"(?:platzhalter|blind|muster|beispiel|dummy|füll)-?(?:text|inhalt|titel|zeile)?\b.{0,60}",
    r"hier (?:steht|stehen|folgt|kommt|erscheint)\b.{0,50}(?:text|beschreibung|inhalt|titel|überschrift)\w*",
    r"(?:job |role |position )?(?:description|details|content|text|information) (?:to follow|coming soon|will follow|to be (?:added|confirmed|announced|completed))\b.{0,40}|coming soon",
    r"(?:ici|la description|le texte|le contenu)\b.{0,30}(?:viendra|suivra|figurera|à venir|sera (?:ajout|compl)\w+).{0,40}",
    r"(?:aquí|la descripci[oó]n|el texto|el contenido)\b.{0,30}(?:ir[aá]|va|vendr[aá]|aparecer[aá]|próximamente|se (?:añadir|completar)á).{0,40}",
    r"(?:hier )?(?:steht |kommt |folgt )?(?:ihr|der|dein) (?:text|titel|inhalt)(?: hier)?(?: ein(?:fügen|geben|zufügen))?",
    r"(?:text|beschreibung|inhalt|titel) (?:hier|folgt|einfügen|ergänzen|fehlt noch)\b.{0,40}",
    r"(?:su|tu|escriba|inserte|introduzca|añada) (?:su |tu |el |un )?(?:texto|t[ií]tulo|descripci[oó]n|contenido)(?: aqu[ií])?\b.{0,30}",
    r"texto (?:de (?:ejemplo|relleno|prueba|muestra)|provisional|por (?:completar|definir)|aqu[ií]|pendiente)\b.{0,40}",
    r"(?:descripci[oó]n|t[ií]tulo|contenido) (?:aqu[ií]|pendiente|por (?:completar|definir))\b.{0,40}",
    r"(?:loading|please wait|chargement(?: en cours)?|laden|wird geladen|lädt|cargando|un instant|einen moment bitte)[\s.…]*",
)

# Whole lines of error pages and of walls before the content.
ERROR = (
    r"(?:http )?(?:error|erreur|fehler)(?: code| n[°o])?[\s:#-]*[a-z]?\d{2,6}\b.{0,120}",
    r"(?:http )?(?:4[0-5]\d|50\d|52\d)\b\s*[-–—:|·.]?\s*(?:error\b.{0,60}|erreur\b.{0,60}|fehler\b.{0,60})?"
    r"(?:page|site|file|resource|url|not found|forbidden|unauthori[sz]ed|bad |gateway|internal|service|too many|server|gone|seite|p[aá]gina|introuvable|nicht|no )?.{0,90}",
    r"(?:error|erreur|fehler)\b\s*(?:page|:|-|–|while|when|lors|beim|al|de chargement|loading|retrieving|connecting)\b?.{0,100}",
    r"(?:the |this |la |cette |diese |die |el |esta )?(?:requested )?(?:page|seite|p[aá]gina|profil|profile|perfil|posting|stelle|offre|oferta|content|contenu|inhalt|url|resource)"
    r"(?: you (?:requested|are looking for))? (?:was |is |could |can |cannot |has |wurde |kann |konnte |ist |n['’]est |est |n['’]existe |no |not |nicht |introuvable|unavailable|inaccesible)"
    r"(?:not |be |been |no |nicht |plus |pas |longer |se |est[aá] |encuentra |disponible |encontrad[oa]|found|loaded|displayed|available|removed|unavailable|gefunden|verfügbar|geladen|angezeigt|trouv[eé]e?|introuvable|charg[eé]).{0,140}",
    r"(?:page|seite|profil|profile|perfil|p[aá]gina)\s+(?:not found|unavailable|nicht gefunden|nicht verfügbar|introuvable|indisponible|no encontrad[oa]|no disponible).{0,120}",
    r"(?:access|acc[eè]s|zugriff|acceso|permission)\s+(?:denied|refus[eé]e?|interdit|verweigert|denegado|forbidden).{0,140}",
    r"(?:forbidden|unauthori[sz]ed|bad gateway|gateway time-?out|internal server error|too many requests|service (?:temporarily )?unavailable|under maintenance)\b.{0,120}",
    r"(?:service|dienst|servicio|le service|der dienst|el servicio)\b.{0,30}(?:unavailable|indisponible|nicht verfügbar|no disponible|fuera de servicio).{0,120}",
    r"(?:your |ihre |votre |su |tu )?(?:session|sitzung|sesi[oó]n)\b.{0,20}(?:has )?(?:expired|timed out|abgelaufen|expir[eé]e?|caducado|expirado|caduc[oó]).{0,120}",
    r"(?:something|etwas|algo|un probl[eè]me|une erreur)\b.{0,20}(?:went wrong|schiefgelaufen|sali[oó] mal|est survenue?|s['’]est produite?).{0,120}",
    r"(?:es ist ein|ein|an|se ha producido un|ha ocurrido un|se produjo un)\b.{0,20}(?:fehler|error)\b.{0,120}",
    r"(?:unhandled|uncaught)\b.{0,140}|(?:type|reference|syntax|range|runtime|null ?pointer)\s?(?:error|exception)\b.{0,140}|traceback \(most recent.{0,60}",
    r"(?:application|server|database|network|connection|client-side|runtime|fatal)\s(?:error|exception)\b.{0,140}|exception in thread.{0,100}",
    r"(?:the |this )?(?:request|connection|page)\b.{0,20}(?:blocked|timed out|was reset|refused|rejected).{0,100}|request blocked.{0,60}",
    r"(?:sign|log) ?in to (?:view|see|continue|access)\b.{0,80}|(?:melden sie sich an|connectez-vous|inicie sesi[oó]n|inicia sesi[oó]n)\b.{0,15}(?:um|pour|para)\b.{0,80}",
    r".{0,40}(?:you are not a robot|are (?:you )?(?:a )?human|unusual traffic|verify you are|captcha|kein roboter|pas un robot|no (?:eres|es usted|soy) un robot).{0,80}",
    r"(?:just a moment|checking your browser|einen moment|un momento|un instant)\b.{0,100}",
    r"(?:no se (?:pudo|ha podido|puede)|could not|cannot|can't|unable to|failed to|impossible de|konnte nicht|echec du)\b.{0,20}(?:cargar|load|charger|geladen|display|mostrar|afficher|connect|find|encontrar|retrieve|fetch|chargement).{0,100}",
    r"(?:fehler|error|erreur|échec)\s+(?:beim|al|de|du|lors du)\s+(?:laden|cargar|chargement|charger).{0,80}",
    r"(?:profile?|profil|perfil|account|konto|compte|cuenta)\s+(?:unavailable|private|not available|deleted|suspended|gesperrt|indisponible|no disponible|priv[eé])\b.{0,60}",
)

# Notices that scripts must run, as orders to the reader or statements about the page.
SCRIPT = (
    r".{0,60}\b(?:enable|activate|turn on|switch on|allow)\b.{0,20}\b(?:javascript|java script|scripts|scripting|js)\b.{0,100}",
    r"(?:this |the |our )?(?:page|site|website|app|application|board|content|portal|form|job board|career site)\b.{0,20}(?:requires?|needs?|relies on|does not work without|will not work without|works? best with|cannot run without).{0,15}\b(?:javascript|scripts|js)\b.{0,80}",
    r"(?:sorry.{0,5} )?(?:javascript|scripts|scripting)\b.{0,10}\b(?:is|are|ist|est|est[aá])\s+(?:disabled|deactivated|turned off|off|blocked|not enabled|deaktiviert|ausgeschaltet|d[eé]sactiv[eé]|desactivado|deshabilitado|inactif).{0,100}",
    r"(?:javascript|scripts) (?:is|are)? ?(?:required|needed|necessary) (?:to|in order|for this (?:page|site|app|board|website)).{0,100}",
    r".{0,40}<noscript.{0,140}",
    r".{0,40}\b(?:aktivieren|schalten|einschalten|erlauben|zulassen)\b.{0,20}\b(?:javascript|skripte)\b.{0,80}|.{0,20}\b(?:javascript|skripte)\b.{0,30}\b(?:aktivieren|einschalten|erlauben|zulassen|benötigt|erforderlich um)\b.{0,60}",
    r".{0,40}\b(?:activer|activez|autoriser|autorisez)\b.{0,20}\b(?:javascript|scripts)\b.{0,80}|(?:ce site|cette page|cette application)\b.{0,20}(?:n[eé]cessite|requiert|exige).{0,15}(?:javascript|scripts).{0,60}",
    r".{0,40}\b(?:active|activa|activar|habilite|habilita|habilitar|permita)\b.{0,20}\b(?:javascript|scripts)\b.{0,80}|(?:este sitio|esta p[aá]gina|esta aplicaci[oó]n)\b.{0,20}(?:requiere|necesita).{0,15}(?:javascript|scripts).{0,60}",
)

# Frequent function words, by which prose is told from labels and from invented Latin.
STOP_WORDS = (
    "the and of to in is for with that on as are was by at or from have has you your we our this it be not will who which they their "
    "der die das und ist in von zu mit für auf den im ein eine wir sie ihr nicht auch bei als wird sind "
    "le la les des et est en pour dans une un nous vous sur avec par du au qui que ce plus pas "
    "el los las y es de por con para una su se del al lo como más no"
).split()

STOP_RE = r"(?i)(?<![\p{L}])(?:" + "|".join(sorted(set(STOP_WORDS))) + r")(?![\p{L}])"
LOREM = r"(?i)\b(?:lorem|ipsum)\b"
#: the least share of function words in prose of the four languages; Latin filler has some of them too (et, in, est)
LATIN_STOPS = 0.15
DECOR = r"(?U)^[\s*#=_~•·>»⚠!|—–-]+|[\s*#=_~•·<«|—–-]+$"


#: a word of regret before a message
REGRET = r"(?:(?:oops|whoops|uh-oh|ouch|sorry|hoppla|ups|huch|oups|aïe|vaya|entschuldigung|pardon|désolé|lo sentimos|wir bitten um entschuldigung)[\s!,.…–-]*)?"


def _whole(patterns: tuple[str, ...]) -> str:
    return r"(?iu)^" + REGRET + r"(?:" + "|".join(f"(?:{p})" for p in patterns) + r")[\s.!…]*$"


#: a line or field that is longer is judged sentence by sentence
MESSAGE_CHARS = 260


def pieces(line: Column) -> Column:
    """(piece, whole): the line, or the sentences of a long one."""
    long = F.filter(F.split(line, r"(?<=[.!?。！？])(?U)\s+"), lambda x: x != "")
    cut_up = F.when(F.length(line) > MESSAGE_CHARS, F.transform(long, lambda x: F.struct(x.alias("piece"), F.lit(False).alias("whole"))))
    return F.coalesce(cut_up, F.array(F.struct(line.alias("piece"), F.lit(True).alias("whole"))))


def _latin(line: Column) -> Column:
    """Hardly any function words."""
    return F.regexp_count(line, F.lit(STOP_RE)) < LATIN_STOPS * F.size(F.split(line, " "))


def with_evidence(df: DataFrame, line: str) -> DataFrame:
    """``df`` and kind: 'placeholder', 'filler', 'error', 'script' or null for one line, field or sentence of these.

    A sentence of a longer line (``whole`` false) is no filler, as it may talk about some. The steps are columns of their own, so that each pattern runs once a line.
    """
    df = df.withColumn("_core", F.regexp_replace(collapse(F.col(line)), DECOR, ""))
    df = df.withColumns(
        {
            "_first": F.when(F.length("_core") <= MESSAGE_CHARS, F.regexp_extract(F.col("_core"), r"^(.*?)(?:\s*[|.]\s*\1)++$", 1)).otherwise(""),
            # any mark of a placeholder at all; most lines have none and are done
            "_marked": F.col(line).rlike(r"[{}%@\[\]$<>]|__|(?i)undefined|null\b|\bnan\b|\bnone\b|\bnil\b"),
        }
    )
    df = df.withColumn("_bare", F.when(F.col("_marked"), F.regexp_replace(F.regexp_replace(F.col(line), QUOTED, " "), EXAMPLE, " ")))
    core = F.col("_core")
    parts = F.filter(F.split(core, r"(?U)\s*[|·@]\s*|\s+(?:at|bei|chez|en)\s+|\s+[-–—]\s+"), lambda x: x != "")
    unset = F.col("_marked") & (F.length(core) <= 120) & F.exists(parts, lambda x: x.rlike(UNSET_FIELD))
    placeholder = F.col("_marked") & (F.col("_bare").rlike(PLACEHOLDER) | F.col("_bare").rlike(UNSET) | unset)
    one = F.when(F.col("_first") != "", F.col("_first")).otherwise(core)
    filler = F.col("whole") & one.rlike(_whole(FILLER)) & ~core.rlike(r"(?i)\b(?:lead|engineer|manager|analyst|writer|designer|developer)\b")
    latin = core.rlike(LOREM) & _latin(core)
    # all notices about scripts name them; most lines are done with that
    scripts = core.rlike(r"(?i)script|skript|\bjs\b")
    kind = (
        F.when(scripts & core.rlike(_whole(SCRIPT)), "script")
        .when(core.rlike(_whole(ERROR)), "error")
        .when(placeholder, "placeholder")
        .when(filler | latin, "filler")
    )
    return df.withColumn("kind", kind).drop("_core", "_first", "_marked", "_bare")


def page_lines(pages: DataFrame, key: str, text: str, url: str) -> DataFrame:
    """(key, host, line, whole, norm): the non-blank lines of each page, long ones by sentence; norm is lower case with digits masked."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^\w+://([^/?#:]+)", 1)), F.lit(""))
    one = pages.select(F.col(key).alias("key"), host.alias("host"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    lines = one.select("key", "host", F.xxhash64("text").alias("text_id"), F.explode(F.split("text", r"\r\n|\n|\r")).alias("line"))
    lines = lines.withColumn("p", F.explode(pieces(F.col("line")))).withColumns({"line": F.col("p.piece"), "whole": F.col("p.whole")}).drop("p")
    norm = F.lower(F.regexp_replace(F.regexp_replace(collapse(F.col("line")), DECOR, ""), r"\d+", "#"))
    return lines.withColumn("norm", norm).where(F.col("norm") != "")


def page_residue(pages: DataFrame, key: str, text: str, url: str, least: int = 3, share: float = 0.05, content_chars: int = 200, latin_share: float = 0.8) -> DataFrame:
    """(key, reason): the pages whose residual has evidence; all of their other columns stay behind.

    A line is a host's boilerplate when it stands in at least ``least`` different texts and in ``share`` of
    the host's texts, and most of these also hold ``content_chars`` characters of other prose. Error
    messages and script notices count only where no such prose is left; placeholders and filler always.
    Null and empty texts give no row.

    Filler in invented Latin is known by its words: those of lines with lorem or ipsum, and lines of which
    ``latin_share`` of the words are among them. No word list is needed, and none is broadcast.
    """
    lines = with_evidence(page_lines(pages, key, text, url), "line")
    prose = (F.length("line") >= 40) & F.col("kind").isNull() & F.col("line").rlike(f"(?s){STOP_RE}.*{STOP_RE}")
    # words of lines that are, or may be, filler in invented Latin: a plain sentence without any function word
    plain = F.col("line").rlike(r"[.!?]\s*$") & ~F.col("line").rlike(r"[^\p{L}\s,;.!?]")
    sure = (F.col("kind") == "filler") & F.col("line").rlike(LOREM)
    maybe = F.col("kind").isNull() & plain & _latin(F.col("line"))
    words = F.when(sure | maybe, F.array_distinct(F.split(F.lower(F.regexp_replace("line", r"[^\p{L}\s]", "")), r"(?U)\s+")))
    lines = lines.withColumn("words", F.filter(words, lambda w: w != ""))
    lines = cut(
        lines.select("key", "host", "text_id", F.xxhash64("norm").alias("norm"), "kind", F.when(prose, F.length("line")).otherwise(0).alias("prose"), "words"),
        "page-lines",
    )
    by_text = lines.groupBy("host", "text_id").agg(F.sum("prose").alias("prose_all"))
    hosts = by_text.groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    seen = lines.groupBy("host", "text_id", "norm").agg(F.max("prose").alias("own"))
    seen = seen.join(by_text, ["host", "text_id"])
    recurrent = (
        seen.groupBy("host", "norm")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prose_all") - F.col("own") >= content_chars).alias("beside"))
        .where(F.col("n") >= least)
        .join(hosts, "host")
        .where((F.col("n") >= share * F.col("texts")) & (2 * F.col("beside") >= F.col("n")))
        .select("host", "norm", F.lit(True).alias("boilerplate"))
    )
    residual = salted_join(lines, recurrent, ["host", "norm"], F.col("key")).where(F.col("boilerplate").isNull())
    verdict = residual.groupBy("key").agg(
        F.sum("prose").alias("prose"),
        F.max(F.when(F.col("kind") == "placeholder", F.lit("placeholder"))).alias("p"),
        F.max(F.when(F.col("kind") == "filler", F.lit("filler"))).alias("f"),
        F.max(F.when(F.col("kind").isin("error", "script"), F.col("kind"))).alias("e"),
    )
    reason = F.coalesce(F.col("p"), F.col("f"), F.when(F.col("prose") < content_chars, F.col("e")))
    found_ = verdict.select("key", reason.alias("reason")).where(F.col("reason").isNotNull())
    latin = lines.where(F.col("kind").isNotNull() & F.col("words").isNotNull()).select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("word", F.lit(1).alias("is_latin"))
    open_ = lines.where(F.col("kind").isNull() & (F.size("words") >= 3)).select("key", "norm", F.explode("words").alias("word"))
    filled = salted_join(open_, latin, ["word"], F.col("key")).groupBy("key", "norm").agg(F.avg(F.coalesce("is_latin", F.lit(0))).alias("share")).where(F.col("share") >= latin_share)
    more = filled.select("key", F.lit("filler").alias("reason"))
    return found_.unionByName(more).groupBy("key").agg(F.min("reason").alias("reason"))


def field_residue(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reason) for a field, which has no boilerplate. Null and empty fields give no row."""
    return (
        rows.select(F.col(key).alias("key"), F.col(text).alias("line"))
        .where(F.col("line").isNotNull())
        .select("key", F.explode(pieces(F.col("line"))).alias("p"))
        .select("key", F.col("p.piece").alias("line"), F.col("p.whole").alias("whole"))
        .transform(with_evidence, "line")
        .where(F.col("kind").isNotNull())
        .groupBy("key")
        .agg(F.min("kind").alias("reason"))
    )


def found(profiles: DataFrame, ats_jobs: DataFrame) -> DataFrame:
    """(source_table, scrape_id, reason) of scraped_profiles and scraped_ats_jobs."""
    a = field_residue(profiles, "scrape_id", "headline").select(F.lit("scraped_profiles").alias("source_table"), F.col("key").alias("scrape_id"), "reason")
    b = page_residue(ats_jobs, "scrape_id", "jd_text", "page_url").select(F.lit("scraped_ats_jobs").alias("source_table"), F.col("key").alias("scrape_id"), "reason")
    return a.unionByName(b)
