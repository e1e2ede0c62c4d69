"""Personal data replaced by keyed surrogates of the same type and form.

All of it is DataFrame functions.  Detected entities are reduced to a canonical value (digits of a
number, lower-cased address, name without title), so all mentions of one entity, however written, get
one surrogate.  A surrogate is drawn from a keyed hash of kind, value and attempt; values whose
surrogate is taken, or is itself an original, draw again until all are distinct.  Each mention is then
written in its own form: punctuation, spacing, letter case, script, country code, card network and check
digit, and top-level domain stay; a name's replacement has the gender of its title.

Defined cases: a null text stays null and has no entities; whole texts are read; texts without
entities pass through unchanged; repeated rows get the same result; ties cannot occur (matches do not
overlap); an empty table gives an empty result; extra columns pass through, an input column named like
an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored
from .spans import match_spans

#: Kinds and their patterns; the leftmost, then the first listed, wins.  None starts inside a word.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z])",
    "card": r"(?<![.-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\w-])",
    "ip": r"(?<![.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![(+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?![\w-])",
    "name": r"(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|г-н|г-жа)\.? [A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-я]+(?: [A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-я]+)?",
}
KINDS = list(PATTERNS)
#: One pattern for all kinds (the card's back reference is the only group).
ANY = r"(?<!\w)(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in ["card", *[k for k in KINDS if k != "card"]]) + ")"
#: What every entity holds: a cheap test that most texts fail before the patterns are tried.
HINT = r"[0-9]{2}|[0-9]\.[0-9]|(?=[MHFSг])(?:M(?:rs?|s|iss|onsieur|adame|me)|Herr|Frau|S(?:ra?|eñora?)|г-н|г-жа)\.? [A-ZÀ-ÖØ-ÞА-Я]"
#: Titles of women; all other titles are men's.
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа)\b"
TITLE = r"^\S+ "
#: Given names by script and gender: fixed values.
GIVEN = {
    ("latin", "f"): ["Alma", "Bella", "Clara", "Dora", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karla", "Laura", "Marta", "Nora", "Olga", "Paula"],
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Lukas", "Martin", "Nils", "Oscar", "Paul"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Зоя", "Инна", "Лидия", "Ольга"],
    ("cyrillic", "m"): ["Антон", "Борис", "Глеб", "Денис", "Егор", "Иван", "Лев", "Олег"],
}
SYLLABLES = {"latin": ["ba", "den", "fel", "gor", "han", "kel", "lin", "mar", "nor", "pel", "ros", "sen", "tal", "ver", "win", "zan"],
             "cyrillic": ["ба", "ден", "фел", "гор", "хан", "кел", "лин", "мар", "нор", "пел", "рос", "сен", "тал", "вер", "вин", "зан"]}


def _kind(v: Column) -> Column:
    out = F.lit("name")
    for k in [k for k in reversed(["card", *[k for k in KINDS if k != "card"]]) if k != "name"]:
        out = F.when(v.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(out)
    return out


def _canonical(kind: Column, v: Column) -> Column:
    digits = F.regexp_replace(v, r"\D", "")
    return (F.when(kind.isin("card", "ssn"), digits).when(kind == "phone", F.when(F.length(digits) > 10, F.expr(
        "right(regexp_replace(value, '[^0-9]', ''), 10)")).otherwise(digits))
        .when(kind == "email", F.lower(v)).when(kind == "iban", F.regexp_replace(v, " ", ""))
        .when(kind == "name", F.concat(F.when(v.rlike(FEMALE), "f:").otherwise("m:"), F.regexp_replace(v, TITLE, "")))
        .otherwise(v))


def _pick(hex_at: str, n: int) -> str:
    """SQL for a number below ``n`` from four hex digits of column ``_h`` at ``hex_at`` (from 0, wrapping)."""
    return f"cast(conv(substr(_h, pmod({hex_at}, 63) * 4 + 1, 4), 16, 10) as int) % {n}"


def _shuffled(s: str) -> str:
    """SQL for ``s`` with every letter and digit replaced by one of its class."""
    abc, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (f"array_join(transform(sequence(1, length({s})), i -> case when substr({s}, i, 1) rlike '[0-9]' then cast({_pick('i', 10)} as string) "
            f"when substr({s}, i, 1) rlike '[a-z]' then substr('{abc}', {_pick('i', 26)} + 1, 1) "
            f"when substr({s}, i, 1) rlike '[A-Z]' then substr('{up}', {_pick('i', 26)} + 1, 1) else substr({s}, i, 1) end), '')")


def _luhn(s: str) -> str:
    """SQL for the check digit that follows the digits of ``s``."""
    return (f"cast((10 - aggregate(sequence(1, length({s})), 0, (a, i) -> a + case when pmod(length({s}) - i, 2) = 0 then "
            f"(cast(substr({s}, i, 1) as int) * 2) % 10 + div(cast(substr({s}, i, 1) as int), 5) else cast(substr({s}, i, 1) as int) end) % 10) % 10 as string)").replace(
                "div(cast(substr(" + s + ", i, 1) as int), 5)", f"cast(floor(cast(substr({s}, i, 1) as int) / 5) as int)")


def draw(values: DataFrame, key: str, attempt: int) -> DataFrame:
    """A candidate ``surrogate`` for each (kind, canon)."""
    blocks = [F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.lit(str(attempt)), F.lit(str(i))), 256) for i in range(4)]
    domain = [F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.regexp_extract("canon", "@(.*)$", 1), F.lit(str(i))), 256) for i in range(4)]
    df = values.withColumn("_h", F.concat(*blocks))
    df = df.withColumn("_local", F.when(F.col("kind") == "email", F.regexp_extract("canon", "^([^@]*)@", 1)))
    df = df.withColumn("_new", F.expr(f"""case
        when kind = 'email' then {_shuffled('_local')}
        when kind in ('ssn', 'phone') then concat(cast(2 + {_pick('0', 8)} as string), substr({_shuffled('canon')}, 2))
        when kind = 'iban' then concat(substr(canon, 1, 2), substr({_shuffled('canon')}, 3))
        when kind = 'card' then concat(substr(canon, 1, 1), substr({_shuffled('canon')}, 2, length(canon) - 2))
        when kind = 'ip' then concat_ws('.', 1 + {_pick('1', 223)}, {_pick('2', 256)}, {_pick('3', 256)}, 1 + {_pick('4', 254)})
        end"""))
    card = F.expr(f"case when kind = 'card' then concat(_new, {_luhn('_new')}) end")
    # the same original domain always has the same new one, so people of one host stay together
    host = df.withColumn("_h", F.concat(*domain)).withColumn("_dom", F.regexp_extract("canon", r"@(.*)\.[^.]*$", 1))
    host = host.withColumn("_dom", F.expr(_shuffled("_dom")))
    email = F.concat("_new", F.lit("@"), "_dom", F.lit("."), F.regexp_extract("canon", r"\.([^.@]*)$", 1))
    host = host.withColumn("_h", F.concat(*blocks))
    name = F.lit(None).cast("string")
    for (script, gender), given in GIVEN.items():
        pool, syl = ", ".join(f"'{x}'" for x in given), ", ".join(f"'{x}'" for x in SYLLABLES[script])
        part = lambda i: f"element_at(array({syl}), {_pick(str(i), len(SYLLABLES[script]))} + 1)"
        surname = f"initcap(concat({part(3)}, {part(4)}, {part(5)}, {part(6)}{''.join(f', {part(7 + i)}' for i in range(attempt))}))"
        first = f"element_at(array({pool}), {_pick('2', len(given))} + 1)"
        whole = f"case when canon like '% %' then concat({first}, ' ', {surname}) else {surname} end"
        here = F.col("canon").startswith(gender + ":") & (F.col("canon").rlike("[А-Яа-я]") == F.lit(script == "cyrillic"))
        name = F.when(here, F.concat(F.lit(gender + ":"), F.expr(whole))).otherwise(name)
    return host.select("kind", "canon", F.when(F.col("kind") == "card", card).when(F.col("kind") == "email", email)
                       .when(F.col("kind") == "name", name).otherwise(F.col("_new")).alias("surrogate"))


def surrogate_table(values: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate): distinct surrogates, none of which is an original of its kind."""
    originals = stored(values.select("kind", "canon").distinct(), "pii_values")
    done, left, attempt = None, originals, 0
    while True:
        tried = draw(left, key, attempt)
        # among values that draw alike the smallest stays; in later rounds earlier surrogates are taken
        order = Window.partitionBy("kind", "surrogate").orderBy("canon")
        taken = originals.select("kind", F.col("canon").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        tried = tried.withColumn("turn", F.row_number().over(order)).join(
            taken.distinct().withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        tried = stored(tried.select("kind", "canon", "surrogate", (F.col("taken").isNull() & (F.col("turn") == 1)).alias("free")), "pii_draw")
        good = tried.where("free").drop("free")
        done = good if done is None else done.unionByName(good)
        left = tried.where("not free").select("kind", "canon")
        if left.isEmpty():
            return done
        attempt += 1


def _written(kind: Column) -> Column:
    """The surrogate in the form of the mention ``value``."""
    number = F.expr("""array_join(transform(sequence(1, length(value)), i -> case when substr(value, i, 1) rlike '[0-9]'
        and length(regexp_replace(substr(value, i), '[^0-9]', '')) <= length(surrogate)
        then substr(surrogate, length(surrogate) - length(regexp_replace(substr(value, i), '[^0-9]', '')) + 1, 1)
        else substr(value, i, 1) end), '')""")
    spaced = F.expr("""array_join(transform(sequence(1, length(value)), i -> case when substr(value, i, 1) = ' ' then ' '
        else substr(surrogate, length(replace(substr(value, 1, i), ' ', '')), 1) end), '')""")
    cased = F.expr("""array_join(transform(sequence(1, length(surrogate)), i -> case when substr(value, i, 1) rlike '[A-Z]'
        then upper(substr(surrogate, i, 1)) else substr(surrogate, i, 1) end), '')""")
    titled = F.concat(F.regexp_extract("value", TITLE, 0), F.expr("substr(surrogate, 3)"))
    return (F.when(kind.isin("card", "ssn", "phone"), number).when(kind == "iban", spaced).when(kind == "email", cased)
            .when(kind == "name", titled).otherwise(F.col("surrogate")))


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and a new column ``n_pii`` (long).

    Equal texts have equal results, so mentions are gathered and replaced once for each distinct text
    (by its 64-bit hash and length) and only rows with entities are shuffled, in skew-splitting joins.
    """
    docs = docs.drop("n_pii") if "n_pii" in docs.columns else docs
    hint = F.contains(F.col(text), F.lit("@")) | F.col(text).rlike(HINT)
    has = F.coalesce(hint & F.col(text).rlike(ANY), F.lit(False))
    key_of = [F.xxhash64(text).alias("_id"), F.length(text).alias("_len")]
    marked = docs.where(has).select("*", *key_of)
    mentions = stored(marked.select("_id", "_len", match_spans(F.col(text), ANY).alias("m")).groupBy("_id", "_len").agg(
        F.first("m").alias("m")).select("_id", "_len", F.posexplode("m").alias("at", "s"))
        .select("_id", "_len", "at", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))
        .withColumn("kind", _kind(F.col("value"))).withColumn("canon", _canonical(F.col("kind"), F.col("value"))), "pii_mentions")
    table = surrogate_table(mentions, key)
    swaps = (mentions.join(table, ["kind", "canon"]).withColumn("new", _written(F.col("kind")))
             .groupBy("_id", "_len").agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("_swaps")))
    parts = F.expr(f"""aggregate(_swaps, struct(1 as at, cast(array() as array<string>) as out),
        (a, s) -> struct(s.end + 1 as at, concat(a.out, array(substr(`{text}`, a.at, s.start + 1 - a.at), s.new)) as out),
        a -> concat(array_join(a.out, ''), substr(`{text}`, a.at)))""")
    changed = marked.join(swaps, ["_id", "_len"]).withColumn("n_pii", F.size("_swaps").cast("long")).withColumn(text, parts)
    return changed.select(*docs.columns, "n_pii").unionByName(docs.where(~has).withColumn("n_pii", F.lit(0).cast("long")))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replace_pii(docs.select("doc_id", "text"), key="surrogates-1")
