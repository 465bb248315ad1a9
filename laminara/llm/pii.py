"""Surrogates for personal data: keyed replacements of the same type, gender, script and format.

Everything is DataFrame and SQL functions. Mentions are found by one regular expression. Mentions of one entity have
one canonical value, and each canonical value gets a surrogate from a keyed digest, so a mention is replaced alike in
every document. A surrogate that another entity has, or that is itself a value in the corpus, is drawn again with the
next attempt number until none clashes; so different entities stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laminara.llm.common import Stored, by_ids, read_table, release

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
GROUP = r"[0-9A-Fa-f]{1,4}"
#: Titles by the gender they tell; those of the third list tell none.
MALE = "Mr|Mister|Sir|Herr|Herrn|Monsieur|Señor|Sr|Don|Господин|Г-н|Κύριος|Κος"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mademoiselle|Mlle|Señora|Señorita|Sra|Srta|Doña|Госпожа|Г-жа|Κυρία|Κα"
NEITHER = "Dr|Prof|Professor|Doctor|Docteur|Doktor"
MALE, FEMALE, NEITHER = (f"{x}|{x.upper()}" for x in (MALE, FEMALE, NEITHER))
TITLES = f"{MALE}|{FEMALE}|{NEITHER}"
GAP = "[ \u00A0]"
#: What a title's run ends before: words between names, week days and months, and titles themselves.
BETWEEN = "And|Or|The|Of|Und|Oder|Et|Ou|Και|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|January|February|March|April|May|June|July|August|September|October|November|December|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember"
BETWEEN = f"{BETWEEN}|{BETWEEN.upper()}|{TITLES}"
#: A word of a name: an apostrophe belongs to it unless it begins a possessive.
WORD = rf"(?!(?:{BETWEEN})(?![\p{{L}}'’-]))\p{{Lu}}(?:[\p{{L}}-]|['’](?![sS](?!\p{{L}}))(?=\p{{L}}))++"
#: One title or several.
RUN = rf"(?:(?:{TITLES})(?:\.{GAP}{{0,2}}|{GAP}{{1,2}}))+"
#: Kind to pattern, tried in this order. Look-behinds keep a scan linear: only the start of a word can begin a match.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}",
    "secret": r"(?<!\w)(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?=[+/_-]*+[A-Za-z0-9])[A-Za-z0-9+/_-]{8,}",
    "access_key": r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ipv6": rf"(?<![\w:.])(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{2,6}}(?::{GROUP}){{1,5}})(?![\w:.])",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "hex_token": r"(?<!\w)(?:[0-9a-f]{40}|[0-9a-f]{64})(?!\w)",
    "name": rf"(?<!\w){RUN}(?:\p{{Lu}}\.{GAP}?){{0,3}}{WORD}(?:{GAP}{WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every text with a mention holds; cheap to look for, so that most texts never meet the patterns. Titles are
#: looked for at their first letters only.
HINT = rf"[0-9@=:]|AKIA|[a-f]{{40}}|(?=[{''.join(sorted({t[0] for t in TITLES.split('|')}))}])(?<!\w)(?:{TITLES})(?:\.{GAP}{{0,2}}|{GAP}{{1,2}})\p{{Lu}}"
#: Parts of made-up names by script; an ending tells the gender.
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te to va ve vi vo".split()}
SYLLABLES["cyrillic"] = "ба бе бо да де до га го ка ко ла ле ло ма ме ми мо на не ни но па пе ра ре ри ро са се со та те то ва ве ви во фа фе зи зо".split()
SYLLABLES["greek"] = "βα βε βο δα δε δο γα γο κα κο λα λε λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σο τα τε το φα φε φι φο ζα ζε ζι ζο".split()
ENDINGS = {("latin", "m"): ["rd", "nt", "lf", "ck"], ("latin", "f"): ["ra", "na", "lia", "ssa"], ("cyrillic", "m"): ["рд", "нт", "льф", "кин"], ("cyrillic", "f"): ["ра", "на", "лия", "сса"], ("greek", "m"): ["κης", "δης", "πος", "ρος"], ("greek", "f"): ["κη", "δη", "λια", "ρα"]}
ENDINGS |= {(script, "x"): ["l", "r", "n"] if script == "latin" else ["л", "р", "н"] if script == "cyrillic" else ["λις", "ρις"] for script in SYLLABLES}
#: Draws of one kind and shape before they grow longer, and rounds of draws in all.
SAME_SHAPE, ATTEMPTS = 8, 64
#: Entities in one task of a round of draws, about.
DRAWN = 2000


def lit_array(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def byte(i: str) -> str:
    """SQL for a number from 0 to 65535 of the digest d."""
    return f"cast(conv(substr(d, cast(pmod(4 * ({i}), 124) as int) + 1, 4), 16, 10) as int)"


def shaped(v: str, keep: str = "0", shift: str = "0", hexadecimal: bool = False) -> str:
    """SQL that replaces digits by digits and letters by letters of the same case, but for the first ``keep``
    characters; of ``hexadecimal`` kinds values of such digits only stay such. ``shift`` moves the place in the digest."""
    hexed = f"{v} rlike '^[0-9a-f]+$' and {v} rlike '[a-f]'" if hexadecimal else "false"
    return f"""array_join(transform(split({v}, ''), (c, i) -> case when i < {keep} then c
        when {hexed} then substr('0123456789abcdef', pmod({byte(f'i + {shift}')}, 16) + 1, 1)
        when c rlike '[0-9]' then substr('0123456789', pmod({byte(f'i + {shift}')}, 10) + 1, 1)
        when c rlike '[a-z]' then substr('abcdefghijklmnopqrstuvwxyz', pmod({byte(f'i + {shift}')}, 26) + 1, 1)
        when c rlike '[A-Z]' then substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', pmod({byte(f'i + {shift}')}, 26) + 1, 1)
        else c end), '')"""


def luhn(v: str) -> str:
    """SQL for the check digit that follows the digits ``v``."""
    digit = f"cast(substr({v}, length({v}) - i, 1) as int)"
    total = f"aggregate(transform(sequence(0, length({v}) - 1), i -> if(i % 2 = 1, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))), 0, (a, x) -> a + x)"
    return f"cast(pmod(10 - pmod({total}, 10), 10) as string)"


def made_name() -> str:
    """SQL for a name of the script and gender in ``canon``, longer with later attempts."""
    cases = []
    for (script, gender), ends in ENDINGS.items():
        s = lit_array(SYLLABLES[script])
        parts = f"array_join(transform(sequence(1, 3 + attempt div 4), i -> element_at({s}, pmod({byte('i')}, {len(SYLLABLES[script])}) + 1)), '')"
        cases.append(f"when canon like '{gender}|{script}|%' then concat('{gender}|{script}|', {parts}, element_at({lit_array(ends)}, pmod({byte('0')}, {len(ends)}) + 1))")
    return "case " + " ".join(cases) + " end"


def canonical() -> str:
    """SQL for the value that all mentions of an entity share; of a name, each ``word`` is one."""
    digits = "regexp_replace(mention, '[^0-9]', '')"
    gender = rf"if(mention rlike '(?<!\\p{{L}})(?:{FEMALE})(?:\\.|{GAP})', 'f', if(mention rlike '(?<!\\p{{L}})(?:{MALE})(?:\\.|{GAP})', 'm', 'x'))"
    script = r"if(word rlike '\\p{IsCyrillic}', 'cyrillic', if(word rlike '\\p{IsGreek}', 'greek', 'latin'))"
    return f"""case kind when 'email' then lower(mention) when 'ipv6' then lower(mention)
        when 'secret' then regexp_extract(mention, '([A-Za-z0-9+/_-]{{8,}})$', 1)
        when 'phone' then if(mention like '+%', {digits}, concat('1', {digits})) when 'card' then {digits}
        when 'iban' then replace(mention, ' ', '')
        when 'name' then concat({gender}, '|', {script}, '|', lower(word))
        else mention end"""


def name_words() -> str:
    """SQL for the words of a name without its title and initials; of other kinds the mention itself."""
    slashed = lambda x: x.replace("\\", "\\\\").replace("'", "\\'")
    return f"if(kind = 'name', regexp_extract_all(regexp_replace(mention, '^{slashed(RUN)}', ''), '({slashed(WORD)})', 1), array(mention))"


def with_gender(spread: DataFrame) -> DataFrame:
    """Names whose titles tell no gender take that of the same name's other mentions in the text, if these agree."""
    same = Window.partitionBy("text_id", "kind", F.substring_index("canon", "|", -2))
    told = F.array_remove(F.collect_set(F.left("canon", F.lit(1))).over(same), "x")
    fits = (F.col("kind") == "name") & F.col("canon").startswith("x|") & (F.size("told") == 1)
    return spread.withColumn("told", told).withColumn("canon", F.when(fits, F.concat(F.get("told", F.lit(0)), F.expr("substr(canon, 2)"))).otherwise(F.col("canon"))).drop("told")


def iban() -> str:
    """SQL for an IBAN of the same country and shape with right check digits."""
    body = shaped("substr(canon, 5)")
    spelt = lambda v: f"array_join(transform(split({v}, ''), c -> if(c rlike '[A-Z]', cast(ascii(c) - 55 as string), c)), '')"
    rest = f"aggregate(split({spelt(f'concat({body}, left(canon, 2), {chr(39)}00{chr(39)})')}, ''), 0, (a, x) -> (10 * a + cast(x as int)) % 97)"
    return f"concat(left(canon, 2), lpad(cast(98 - {rest} as string), 2, '0'), {body})"


def surrogate() -> str:
    """SQL for the surrogate of ``canon`` of ``kind``, from the digest ``d``; domains have a digest ``dd`` of their own."""
    local, domain = "substring_index(canon, '@', 1)", "substring_index(canon, '@', -1)"
    host = shaped(f"substring_index({domain}, '.', size(split({domain}, '\\\\.')) - 1)").replace("substr(d,", "substr(dd,")
    octet = lambda k: f"cast(1 + pmod({byte(str(k))}, 254) as string)"
    body = shaped("substr(canon, 1, length(canon) - 1)", "1")
    valid = f"{luhn('substr(canon, 1, length(canon) - 1)')} = right(canon, 1)"
    longer = lambda c: f"if(attempt < {SAME_SHAPE}, '', {c})"
    hexed = f"substr(d, 1, 2 + attempt div {SAME_SHAPE})"
    more = f"array_join(transform(sequence(1, attempt div {SAME_SHAPE}), i -> cast(pmod({byte('i')}, 10) as string)), '')"
    sixes = f"array_join(transform(split(canon, ''), (c, i) -> if(c = ':', c, substr('0123456789abcdef', pmod({byte('i')}, 16) + 1, 1))), '')"
    whole = "concat_ws(':', '2001:db8', substr(d, 1, 4), substr(d, 5, 4), substr(d, 9, 4), substr(d, 13, 4), substr(d, 17, 4), substr(d, 21, 4))"
    return f"""case kind
        when 'email' then concat({shaped(local)}, {longer(hexed)}, '@', {host}, '.', substring_index({domain}, '.', -1))
        when 'ip' then if(attempt < {4 * SAME_SHAPE}, concat_ws('.', {', '.join(octet(k) for k in range(4))}), {whole})
        when 'ipv6' then if(attempt < {SAME_SHAPE}, {sixes}, {whole})
        when 'card' then if({valid}, concat({body}, {luhn(body)}), {shaped('canon', '1')})
        when 'access_key' then {shaped('canon', '4')}
        when 'iban' then {iban()}
        when 'phone' then concat(if(canon like '1%' and length(canon) = 11, {shaped('canon', '1')}, {shaped('canon')}), {longer(more)})
        when 'name' then {made_name()}
        when 'secret' then concat({shaped('canon', hexadecimal=True)}, {longer(hexed)})
        else concat({shaped('canon', hexadecimal=True)}, {longer(more)}) end"""


def render() -> str:
    """SQL for a mention with its surrogate ``s`` in the mention's own format; for a name, of its ``word``."""
    place = "length(regexp_replace(substr(mention, 1, i + 1), '[^0-9]', ''))"
    total = "length(regexp_replace(mention, '[^0-9]', ''))"
    # A phone number without its country code takes the digits behind it; digits that a longer draw adds follow.
    lead = "if(kind = 'phone' and mention not like '+%', 1, 0)"
    digits = f"array_join(transform(split(mention, ''), (c, i) -> if(c rlike '[0-9]', substr(s, {place} + {lead}, 1), c)), '')"
    letters = "length(replace(substr(mention, 1, i + 1), ' ', ''))"
    return f"""case when kind in ('phone', 'card') then concat({digits}, substr(s, {total} + {lead} + 1))
        when kind = 'iban' then array_join(transform(split(mention, ''), (c, i) -> if(c = ' ', c, substr(s, {letters}, 1))), '')
        when kind = 'secret' then concat(left(mention, length(mention) - length(canon)), s)
        when kind = 'name' then if(word = upper(word), upper(substring_index(s, '|', -1)), initcap(substring_index(s, '|', -1)))
        when kind in ('email', 'ipv6') and mention = upper(mention) then upper(s)
        else s end"""


def put_names(text: Column, names: Column) -> Column:
    """``text`` with every whole word of ``names`` (structs of word and shown) replaced."""
    pattern = lambda w: F.concat(F.lit("(?<![\\p{L}\\p{N}])\\Q"), w, F.lit("\\E(?![\\p{L}\\p{N}])"))
    return F.aggregate(names, text, lambda t, n: F.regexp_replace(t, pattern(n["word"]), n["shown"]))


def kind_of() -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(F.col("mention").rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def assign(entities: DataFrame, key: str) -> Stored:
    """(kind, canon, s) for different (kind, canon): surrogates that differ from each other and from all of canon.

    Each round draws for what is left, in tasks of a bounded number of entities, keeps the smallest canon of those that drew alike, and puts off the others and
    those whose draw is taken.
    """
    spark = entities.sparkSession
    entities = entities.repartition(max(1, -(-entities.count() // DRAWN)), "kind", "canon")
    todo, done, old = entities.withColumn("attempt", F.lit(0)), None, []
    for attempt in range(ATTEMPTS):
        digest = lambda v: F.concat(F.sha2(F.concat_ws("|", F.lit(key), "kind", v, F.lit(str(attempt))), 256), F.sha2(F.concat_ws("|", F.lit(str(attempt)), v, "kind", F.lit(key)), 256))  # noqa: E731, B023
        domain = F.concat(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index("canon", "@", -1)), 256), F.sha2(F.substring_index("canon", "@", -1), 256))
        drawn = todo.withColumn("attempt", F.lit(attempt)).withColumn("d", digest(F.col("canon"))).withColumn("dd", domain).select("kind", "canon", F.expr(surrogate()).alias("s"))
        first = drawn.groupBy("kind", "s").agg(F.min("canon").alias("first"))
        taken = entities.select("kind", F.col("canon").alias("s"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "s"))
        taken = taken.distinct().withColumn("taken", F.lit(True))
        tried = Stored(drawn.join(first, ["kind", "s"]).join(taken, ["kind", "s"], "left").select("kind", "canon", "s", (F.col("taken").isNull() & (F.col("canon") == F.col("first"))).alias("good")))
        old.append(tried)
        good = tried.df.where("good").select("kind", "canon", "s")
        done = good if done is None else done.unionByName(good)
        todo = tried.df.where("not good").select("kind", "canon")
        if todo.isEmpty():
            break
    else:
        raise RuntimeError(f"surrogates still clash after {ATTEMPTS} attempts")
    out = Stored(done)
    for t in old:
        t.drop()
    release(spark)
    return out


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text`` and a column ``n_entities`` with the number of mentions replaced.

    ``key`` is the secret of the surrogates: the same key gives the same ones. All other columns stay; an old
    ``n_entities`` is replaced. A null text stays null with 0 mentions, an empty one stays empty. Rows may repeat and
    ids may be null. The patterns go over each text once, and over those with a mention once more to cut them; only
    these are shuffled while they are few. A mention in very many documents is one entity and is joined on its value,
    which adaptive execution splits when it is skewed. The names of a title's bearer, given names too, are replaced in the
    rest of the text; a title that tells no gender ("Dr.") goes with the one of that name that does, if the text has one. Secrets without a letter or digit, such as blanks of a form, are no secrets.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    text_id = F.md5(F.col("text").cast("string"))
    seen = docs.where(F.coalesce(F.col("text").rlike(HINT), F.lit(False))).select(text_id.alias("text_id"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("found"))
    seen = Stored(seen.where(F.size("found") > 0).dropDuplicates(["text_id"]))
    spread = seen.df.select("text_id", F.explode(F.array_distinct("found")).alias("mention")).withColumn("kind", kind_of())
    spread = spread.withColumn("word", F.explode(F.expr(name_words()))).withColumn("canon", F.expr(canonical()))
    mentions = Stored(with_gender(spread))
    table = assign(mentions.df.select("kind", "canon").distinct(), key)
    shown = mentions.df.join(table.df, ["kind", "canon"]).select("text_id", "mention", "kind", "word", F.expr(render()).alias("shown"))
    named = F.sort_array(F.collect_set(F.struct("word", "shown")))
    whole = shown.groupBy("text_id", "mention", "kind").agg(named.alias("words"))
    last = F.regexp_extract("mention", f"({WORD})$", 1)
    surname = F.filter("words", lambda x: x["word"] == F.col("last"))
    replaced = put_names(F.col("mention"), F.col("words"))
    # Initials become the first letter of the new family name.
    initial = F.concat(F.lit("$1"), F.coalesce(F.substring(F.get(surname, F.lit(0))["shown"], 1, 1), F.lit("")), F.lit("."))
    replaced = F.regexp_replace(replaced, F.lit(f"((?:{GAP}|(?<=\\p{{Lu}}\\.)))\\p{{Lu}}\\."), initial)
    whole = whole.withColumn("last", last).select(
        "text_id", "mention", F.when(F.col("kind") == "name", replaced).otherwise(F.col("words")[0]["shown"]).alias("shown"),
        F.when(F.col("kind") == "name", F.filter("words", lambda x: F.length(x["word"]) > 2)).otherwise(F.array().cast("array<struct<word:string,shown:string>>")).alias("surnames"),
    )
    by_text = whole.groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("mention", "shown"))).alias("shown_as"), F.array_distinct(F.flatten(F.collect_list("surnames"))).alias("surnames"))
    maps = Stored(seen.df.join(by_text, "text_id"))
    for t in (mentions, table):
        t.drop()
    tag = "text_id"
    while tag in names:
        tag += "_"
    tagged, ids = docs.select(*names).withColumn(tag, text_id), maps.df.select(F.col("text_id").alias(tag))
    plain = by_ids(tagged, ids, "left_anti").select(*names, F.lit(0).alias("n_entities"))
    # All columns travel in one, so that their names can't clash with those below.
    full = by_ids(tagged, ids, "left_semi").select(F.col(tag).alias("text_id"), F.struct(*names).alias("doc"))
    parts = F.transform(F.split(F.col("doc.text"), ANY, -1), lambda g: put_names(g, F.col("surnames")))
    text = F.array_join(F.transform(parts, lambda g, i: F.concat(g, F.coalesce(F.element_at("shown_as", F.get("found", i)), F.lit("")))), "")
    changed = full.join(maps.df, "text_id").select(*(text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in names), F.size("found").alias("n_entities"))
    return plain.unionByName(changed)


#: The key of the registered query and the pipeline; a real corpus takes a secret one.
DEMO_KEY = "key of the registered query"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for the personal data in its whole text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, DEMO_KEY).select("doc_id", "text", "n_entities")
