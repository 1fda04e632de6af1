"""Link the spellings of names that people typed in many ways.

Distinct names are parsed into tokens; those that parse alike are one form.
Tokens live in the metric space of the unrestricted Damerau-Levenshtein
distance. Its pivots are one long run of each letter: the distance of a token
to the run of ``c`` is the length of the run less the number of ``c`` in the
token, so the distances to all pivots, its cell, need no table of pivots. A
token within the radius differs by at most one step from each pivot (triangle
inequality), so a token is replicated to the cells one step further from a
pivot, and every close pair meets in a cell, where the true distance is
computed. Cells hold near-anagrams only, whatever the number of names.
A form meets another where a close token stands in an equal context (the other
tokens, or their nicknames or initials); such pairs are compared part by part,
and linked names form acts by label propagation. No token is too common, and
none too short, to be a key, because the context is part of the key.

Defined results: null, empty and blank names are left out; names differ by case
and inner spaces; repeated rows count as one name; an initial that fits several
given names of one surname links to none of them.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.io import materialize

#: Names that one task of Python parses, so that tasks stay alike at any size.
ROWS_PER_TASK = 20_000

# Kinds of ensemble with their abbreviations and translations (fixed values).
KINDS = {
    "orchestra": "orchestra orch orchestre orchester orquesta orquestra orkester orchestr",
    "ensemble": "ensemble ens ensembl",
    "collective": "collective coll collectif kollektiv colectivo coletivo",
    "quartet": "quartet 4tet qt quart quartett quatuor cuarteto quarteto qtet",
    "quintet": "quintet 5tet quintett quintette quinteto",
    "trio": "trio 3o tr",
    "brothers": "brothers bros bro",
    "sisters": "sisters",
    "project": "project proj projekt projet proyecto projeto",
    "band": "band",
    "sound": "sound snd",
    "system": "system sys syst",
    "soundsystem": "soundsystem",
}
# Abbreviated first words (fixed values).
SHORT = {
    "deejay": "dj", "dr": "doctor", "doc": "doctor", "st": "saint", "st.": "saint", "capt": "captain", "cpt": "captain", "lil": "little", "lil'": "little",
    "lil’": "little", "yg": "young", "yng": "young", "elec": "electric", "nthn": "northern", "mdnt": "midnight", "n": "&", "and": "&", "+": "&", "et": "&", "und": "&", "y": "&",
}
# Common nicknames of given names (fixed values); more are learned from quoted ones.
NICKNAMES = {
    "abigail": "abby gail", "albert": "al bert bertie", "aleksander": "alek sander sasha alex olek", "alexander": "alex sander sasha xander", "alexandra": "alex sandra sasha", "alfred": "alf fred freddie", "amanda": "mandy",
    "andrew": "andy drew", "anna": "annie nan ania", "anthony": "tony ant", "antonia": "toni nia tonia", "barbara": "barb babs barbie", "bartholomew": "bart barry tolly bat", "benedikt": "benno ben bene", "benjamin": "ben benny benji",
    "catherine": "cathy kate katie cat", "charles": "charlie chuck chas", "charlotte": "lottie charlie lotte lotta carly", "christina": "chris tina chrissy", "christopher": "chris kit topher", "cornelius": "neil corny nelis con",
    "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "desmond": "des dez", "dominique": "dom nika nicki nico", "donald": "don donnie", "dorothy": "dot dottie dolly", "edward": "ed eddie ted ned teddy",
    "eleanor": "ellie nell nora", "elisabeth": "betty liz elsie lisa beth liesel bess lise libby eliza", "elizabeth": "betty liz elsie lisa beth bess libby eliza lizzie", "emmanuel": "manny manu", "eugene": "gene",
    "florence": "flo flora florrie", "francis": "frank fran", "frederick": "fred freddie rick fritz", "gabriella": "gabi ella gabby bella gaby", "george": "georgie", "gerald": "gerry jerry", "gwendolyn": "gwen wendy", "harold": "harry hal",
    "henrietta": "hetty etta hattie henny", "henry": "harry hank hal", "hildegard": "hilde hilda gard gardi", "ignatius": "iggy nace ig", "isabella": "bella izzy isa", "isidore": "izzy dory isi", "jacqueline": "jackie jacky lina",
    "james": "jim jimmy jamie", "johannes": "hans hannes jo", "john": "jack johnny", "jonathan": "jon jonny nathan", "joseph": "joe joey", "josephine": "josie jo fina joey posy", "katarina": "kat kati katya rina", "kenneth": "ken kenny",
    "kimberley": "kim kimmy", "konstantin": "stan kostya kosta konny", "lawrence": "larry laurie lorry laz", "leonard": "len lenny leo", "leopold": "leo poldi pol", "margaret": "maggie meg peggy greta", "margarete": "greta maggie gretchen meg grete peggy",
    "mathilda": "tilda tilly mattie maddie", "matthew": "matt matty", "maximilian": "max maxi", "michael": "mike mick mickey", "nathaniel": "nate nat nathan", "nicholas": "nick nicky klaus", "ottilie": "otti tilly tilda", "patricia": "pat patty trish tricia",
    "patrick": "pat paddy rick", "peter": "pete", "quentin": "quin quent", "rebecca": "becky bec", "richard": "rick dick rich", "robert": "bob rob bobby bert robbie", "ronald": "ron ronnie", "rosalind": "linda roz rosie ros", "samuel": "sam sammy",
    "sebastian": "bastian seb basti", "stephen": "steve stevie", "susanne": "susi sue sanne", "theodora": "dora thea teddy theo", "thomas": "tom tommy", "timothy": "tim timmy", "ulrike": "rike uli ulli", "valentina": "val tina vally", "victoria": "vicky tori",
    "walter": "walt wally", "wilhelmina": "billie mina willa minnie wilma helmi", "william": "bill will billy willy liam", "xaver": "xavi veri", "yolanda": "yola landa yoli", "zacharias": "zack zach zak",
    "александр": "саша шура саня", "алексей": "алеша леша", "анастасия": "настя ася", "владимир": "вова володя", "дмитрий": "дима митя", "екатерина": "катя", "елена": "лена", "иван": "ваня", "игорь": "гоша", "мария": "маша", "михаил": "миша",
    "наталья": "наташа", "николай": "коля", "ольга": "оля", "светлана": "света", "сергей": "сережа", "татьяна": "таня",
}
_KIND = {w: k for k, ws in KINDS.items() for w in ws.split()}


def fold(text: str) -> str:
    """Case, accents, width and ``ph`` folded."""
    return "".join(c for c in ud.normalize("NFKD", text.casefold()) if not ud.combining(c)).replace("ph", "f")


def near(a: str, b: str) -> bool:
    """Damerau-Levenshtein distance of at most one."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i, m = 0, min(la, lb)
    while i < m and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :] if la < lb else a[i + 1 :] == b[i:]


def _is_article(token: str) -> bool:
    """The article, also with a letter lost, doubled or out of place."""
    return set(token) <= set("the") and near(token, "the")


def _kind(token: str) -> str | None:
    got = _KIND.get(token)
    if got is None and len(token) >= 4:
        got = next((k for k in KINDS if near(token, k)), None)
    return got


_QUOTED = re.compile(r"\s*[“”„«»\"‘]([^“”„«»\"‘’]+)[“”„«»\"’]\s*")
_TAIL = re.compile(r"^(.*?)\s*[(\[]([^()\[\]]+)[)\]]\s*$")


def parse(name: str) -> tuple[list[str], str, str, str]:
    """(tokens without kind, kinds, quoted nickname, all joined)."""
    text = fold(name)
    nick = ""
    m = _QUOTED.search(text)
    if m:
        nick, text = m.group(1).strip(), f"{text[: m.start()]} {text[m.end() :]}"
    m = _TAIL.match(text)
    if m:
        text = f"{m.group(2)} {m.group(1)}"
    if "," in text:
        first, _, rest = text.partition(",")
        text = f"{rest} {first}" if rest.strip() else first
    text = text.replace("d.j.", "dj").replace("d. j.", "dj").replace("&", " & ").replace("+", " + ")
    raw = [t for t in re.split(r"[\s.;:!?/_]+", text) if t]
    words: list[str] = []
    for i, t in enumerate(raw):
        t = SHORT.get(t, t) if not (t in ("n", "y") and (i in (0, len(raw) - 1) or len(raw) < 3)) else t
        words.append(t)
    if "&" in words:
        at = words.index("&")
        parts = [words[:at], words[at + 1 :]]
        parts.sort(key=lambda p: bool(p and _is_article(p[0])))
        words = [t for p in parts for i, t in enumerate(p) if i or not _is_article(t)] + ["&"]
    kinds, tokens = [], []
    for i, t in enumerate(words):
        if i == 0 and _is_article(t) and len(words) > 1:
            continue
        k = _kind(t) if len(words) > 1 else None
        if k:
            kinds.append(k)
        else:
            tokens.append(t)
    if not tokens:
        tokens, kinds = list(words), []
    if {"sound", "system", "soundsystem"} & set(kinds):
        kinds = ["soundsystem"]
    kind = "+".join(sorted(set(kinds)))
    return tokens, kind, nick, "".join(tokens) + ("+" + kind if kind else "")


def _parser(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        got = [parse(n) for n in batch["name"]]
        yield pd.DataFrame(
            {
                "name": batch["name"],
                "n": batch["n"],
                "tokens": [g[0] for g in got],
                "kind": [g[1] for g in got],
                "nick": [g[2] for g in got],
                "joined": [g[3] for g in got],
            }
        )


# --- metric space ------------------------------------------------------------------------

#: Letters of a text in order; the text that they spell stands for its distances to all pivots.
_LETTERS = "array_join(array_sort(split(core, '')), '')"
#: The cells one step further from one pivot: one letter less.
_FURTHER = "transform(array_distinct(split(letters, '')), c -> xxhash64(concat(substr(letters, 1, instr(letters, c) - 1), substr(letters, instr(letters, c) + 1))))"


def swapped(a: Column, b: Column) -> Column:
    """One pair of neighbours changes places."""
    at = F.sequence(F.lit(1), F.length(a) - 1)
    one = F.lit(1)
    turned = lambda i: F.concat(F.substr(b, one, i - 1), F.substr(b, i + 1, one), F.substr(b, i, one), F.substr(b, i + 2))
    return F.exists(at, lambda i: a == turned(i))


def radius_join(cores: DataFrame) -> DataFrame:
    """(core_a, core_b) of all pairs of different cores at distance one, code points ascending.

    A pair meets at home (a swap), in the home of the shorter one (a letter more) or, for another letter, one step from both homes.
    """
    home = cores.where("core != ''").distinct().selectExpr("core", f"{_LETTERS} AS letters")
    placed = home.selectExpr("core", "letters", "xxhash64(letters) AS cell", "true AS home").unionByName(
        home.selectExpr("core", "letters", f"explode({_FURTHER}) AS cell", "false AS home")
    )
    a, b = placed.toDF("core_a", "letters_a", "cell", "home_a"), placed.toDF("core_b", "letters_b", "cell", "home_b")
    swap = F.col("home_a") & F.col("home_b") & (F.col("letters_a") == F.col("letters_b")) & swapped(F.col("core_a"), F.col("core_b"))
    step = (F.col("letters_a") != F.col("letters_b")) & (F.levenshtein("core_a", "core_b", 1) >= 0)
    return a.join(b, "cell").where((F.col("core_a") < F.col("core_b")) & (swap | step)).select("core_a", "core_b").distinct()


# --- linking ------------------------------------------------------------------------------


def _alike(x: str, y: str) -> bool:
    return x == y or (min(len(x), len(y)) >= 4 and near(x, y))


def _formal(name: dict, token: str) -> set[str]:
    """The given names that a token of the name can stand for, itself included."""
    return {token} | {f["formal"] for f in name["formal"] if f["nick"] == token}


def relation(a: dict, b: dict) -> str | None:
    """How two parsed names are the same act: ``same``, ``typo``, ``given``, ``initial_a`` or ``initial_b`` (that side has the initial), or None."""
    if a["kind"] != b["kind"]:
        return None
    ta, tb = list(a["tokens"]), list(b["tokens"])
    if sorted(ta) == sorted(tb) or a["joined"] == b["joined"]:
        return "same"
    typos = 0
    left = []
    for t in ta:
        if t in tb:
            tb.remove(t)
        else:
            left.append(t)
    # a typo inside one longer token, or a lost or gained space
    if len(left) == 1 and len(tb) == 1 and len(left[0]) > 3 and len(tb[0]) > 3 and near(left[0], tb[0]):
        return "typo"
    if near(a["joined"], b["joined"]) and len(ta) != len(b["tokens"]):
        return "typo"
    if a["kind"] or "&" in a["tokens"] or "&" in b["tokens"] or "dj" in a["tokens"] or "dj" in b["tokens"]:
        if len(left) == len(tb) == 2:
            rest = list(tb)
            for t in left:
                hit = next((r for r in rest if _alike(t, r)), None)
                if hit is None:
                    return None
                rest.remove(hit)
            return "typo"
        return None
    # persons: one shared (or mistyped) surname, the rest are given names
    shared = [t for t in ta if t not in left]
    if not any(len(t) > 1 for t in shared):
        pair = next(((x, y) for x in left for y in tb if len(x) > 4 and len(y) > 4 and near(x, y)), None)
        if pair is None:
            return None
        left.remove(pair[0])
        tb.remove(pair[1])
        typos = 1
    extra_a = [t for t in left if len(t) > 1]
    extra_b = [t for t in tb if len(t) > 1]
    ia, ib = [t for t in left if len(t) == 1], [t for t in tb if len(t) == 1]
    whole_shared = [t for t in shared if len(t) > 1]
    if len(whole_shared) + typos >= 2 and not extra_a and not extra_b:
        return "given"  # middle initials only
    if len(extra_a) == 1 and len(extra_b) == 1 and not (ia and ib):
        x, y = extra_a[0], extra_b[0]
        formal_x, formal_y = _formal(a, x), _formal(b, y)
        if _alike(x, y) and not typos:
            return "typo"
        if formal_x & formal_y:
            return "given"
        return None
    if len(extra_a) == 1 and not extra_b and len(ib) == 1 and len(whole_shared) + typos == 1:
        return "initial_b" if any(f.startswith(ib[0]) for f in _formal(a, extra_a[0])) else None
    if len(extra_b) == 1 and not extra_a and len(ia) == 1 and len(whole_shared) + typos == 1:
        return "initial_a" if any(f.startswith(ia[0]) for f in _formal(b, extra_b[0])) else None
    return None


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for a, b in zip(batch["a"], batch["b"]):
            how = relation(a, b)
            if how == "initial_b":
                rows.append((b["name"], a["name"], "initial"))
            elif how:
                rows.append((a["name"], b["name"], how.removesuffix("_a")))
        yield pd.DataFrame(rows, columns=["name_a", "name_b", "how"], dtype=object)


def _formal_table(parsed: DataFrame) -> DataFrame:
    """(nick, formal): fixed nicknames and those that names quote after a given name."""
    spark = parsed.sparkSession
    fixed = spark.createDataFrame([(fold(n), fold(g)) for g, ns in NICKNAMES.items() for n in ns.split()], "nick string, formal string")
    learned = parsed.where("nick != '' and kind = ''").select("nick", F.try_element_at("tokens", F.lit(1)).alias("formal"))
    return fixed.union(learned).where("nick != formal").distinct()


def _contexts(tokens: list[str], kind: str, joined: str, formal: list[dict]) -> set[tuple[str, str, str]]:
    """(context, core, side): forms that ``relation`` accepts share a context and have equal or close cores.

    Sides ``i`` (has an initial) and ``f`` (has the given name) meet only each other.
    """
    long, initials = sorted(t for t in tokens if len(t) > 1), {t for t in tokens if len(t) == 1}
    out = {("=", joined, "")}
    stands_for = {t: {t} | {f["formal"] for f in formal if f["nick"] == t} for t in long}
    for g, names in stands_for.items():
        for name in names:
            one = list(long)
            one[one.index(g)] = name
            out |= {(f"w{kind}|{' '.join(sorted(one[:i] + one[i + 1 :]))}", one[i], "") for i in range(len(one))}
    if not long:
        out.add((f"w{kind}|", " ".join(sorted(tokens)), ""))
    if kind or "&" in tokens or "dj" in tokens:
        # two mistyped tokens: one is the core, and one letter less of the other belongs to the context
        typed = [t for t in tokens if len(t) > 3]
        for x in typed:
            for y in typed:
                if x != y:
                    rest = " ".join(sorted(t for t in tokens if t not in (x, y)))
                    out |= {(f"2{kind}|{rest}|{y[:i] + y[i + 1 :]}", x, "") for i in range(len(y) + 1)}
    elif len(long) == 1:
        out |= {(f"i{i}", long[0], "i") for i in initials}
    elif len(long) == 2:
        for g, core in (long, long[::-1]):
            out |= {(f"i{name[0]}", core, "f") for name in stands_for[g]}
    return out


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [
            (form, *entry)
            for form, tokens, kind, joined, formal in zip(batch["form"], batch["tokens"], batch["kind"], batch["joined"], batch["formal"])
            for entry in _contexts(list(tokens), kind, joined, list(formal))
        ]
        yield pd.DataFrame(rows, columns=["form", "context", "core", "side"], dtype=object)


def link(names: DataFrame) -> DataFrame:
    """(name_a, name_b, how) of directly linked names from (name, n); of ``initial`` links, name_a has the initial."""
    schema = "name string, n long, tokens array<string>, kind string, nick string, joined string"
    tasks = max(names.sparkSession.sparkContext.defaultParallelism, -(-names.count() // ROWS_PER_TASK))
    parsed = materialize(names.repartition(tasks).mapInPandas(_parser, schema))
    # names that parse alike are one form, called by its smallest name
    spelled = F.xxhash64(F.array_sort("tokens"), "kind", "joined")
    forms = parsed.groupBy(spelled.alias("key")).agg(F.min("name").alias("form"), F.any_value("tokens").alias("tokens"), F.any_value("kind").alias("kind"), F.any_value("joined").alias("joined"))
    alike = parsed.withColumn("key", spelled).join(forms.select("key", "form"), "key").where("name != form")
    alike = alike.select(F.col("form").alias("name_a"), F.col("name").alias("name_b"), F.lit("same").alias("how"))
    token = forms.select("form", F.explode("tokens").alias("token"))
    formal = _formal_table(parsed)
    given = token.join(formal, token["token"] == formal["nick"]).groupBy("form").agg(F.collect_set(F.struct("nick", "formal")).alias("formal"))
    none = F.expr("cast(array() as array<struct<nick:string,formal:string>>)")
    full = materialize(forms.drop("key").join(given, "form", "left").withColumn("formal", F.coalesce("formal", none)))
    entries = full.repartition(tasks).mapInPandas(_entries, "form string, context string, core string, side string")
    entries = materialize(entries.select("form", F.xxhash64("context").alias("context"), "core", "side"))
    close = radius_join(entries.where(F.length("core") > 3).select("core"))
    either = close.union(close.select("core_b", "core_a")).toDF("core", "other")
    left = entries.where("side != 'f'").withColumnRenamed("form", "form_a")
    near_by = left.join(either, "core").select("form_a", "side", "context", F.col("other").alias("core"))
    right = entries.where("side != 'i'").select(F.col("form").alias("form_b"), "context", "core", F.col("side").alias("side_b"))
    met = left.select("form_a", "side", "context", "core").unionByName(near_by).join(right, ["context", "core"])
    met = met.where("(side = '' and side_b = '' and form_a < form_b) or (side = 'i' and side_b = 'f')")
    pairs = met.select(F.least("form_a", "form_b").alias("form_a"), F.greatest("form_a", "form_b").alias("form_b")).distinct()
    one = full.select("form", F.struct(F.col("form").alias("name"), "tokens", "kind", "joined", "formal").alias("s"))
    candidates = pairs.join(one.toDF("form_a", "a"), "form_a").join(one.toDF("form_b", "b"), "form_b").select("a", "b")
    return alike.unionByName(candidates.mapInPandas(_compare, "name_a string, name_b string, how string"))


def acts(names: DataFrame) -> DataFrame:
    """(name, act): the act of every name that has another spelling; the act's id is its smallest name.

    Sure links are followed to their ends by label propagation; an initial joins an act only if no other fits.
    """
    links = materialize(link(names))
    sure = links.where("how != 'initial'").select("name_a", "name_b")
    labels = propagate(sure)
    vague = links.where("how = 'initial'").select(F.col("name_a").alias("name"), F.col("name_b").alias("other"))
    known = labels.select(F.col("name").alias("other"), "act")
    seen = materialize(vague.join(known, "other", "left").withColumn("act", F.coalesce("act", "other")))
    # the abbreviated side: a name whose own act would join several others stays out
    mine = labels.select("name", F.col("act").alias("own"))
    ties = (
        seen.join(mine, "name", "left")
        .withColumn("own", F.coalesce("own", "name"))
        .where(F.col("own") != F.col("act"))
        .groupBy("own")
        .agg(F.min("act").alias("act"), F.min("act").alias("lo"), F.max("act").alias("hi"))
        .where("lo = hi")
        .select(F.col("own").alias("name_a"), F.col("act").alias("name_b"))
    )
    one_way = ties.select(F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b")).distinct()
    return propagate(sure.unionByName(one_way))


def propagate(links: DataFrame) -> DataFrame:
    """(name, act) for the connected parts of the links, by smallest label with pointer jumping."""
    edges = materialize(links.union(links.select("name_b", "name_a")).toDF("name", "other").distinct())
    labels = materialize(edges.groupBy("name").agg(F.least(F.min("other"), F.col("name")).alias("act")))
    while True:
        near_by = edges.join(labels.toDF("other", "their"), "other").groupBy("name").agg(F.min("their").alias("their"))
        lower = labels.join(near_by, "name").select("name", "act", F.least("act", "their").alias("new"))
        jump = labels.toDF("new", "next")
        after = materialize(
            lower.join(jump, "new", "left").select("name", F.col("act").alias("old"), F.least("new", F.coalesce("next", "new")).alias("act"))
        )
        labels = after.select("name", "act")
        if after.where("act != old").limit(1).count() == 0:
            return labels


def pairs_of(labels: DataFrame) -> DataFrame:
    """(name_a, name_b) of all spellings of one act, by code points."""
    right = labels.select(F.col("name").alias("name_b"), "act")
    return labels.select(F.col("name").alias("name_a"), "act").join(right, "act").where(F.col("name_a") < F.col("name_b")).drop("act")


_CREDIT = r"(?:^|[\s(\[])(?:feat\.|ft\.|featuring|with)\s+([^()\[\]]+)"
_REMIX = r"(?:[(\[]| - )((?:(?! - )[^()\[\]])+?)\s+(?:Remix|Rework)\b"


def credited(title: Column) -> Column:
    """Names that a title credits."""
    return F.transform(
        F.concat(F.regexp_extract_all(title, F.lit(_CREDIT), 1), F.regexp_extract_all(title, F.lit(_REMIX), 1)), lambda x: F.trim(x)
    )
