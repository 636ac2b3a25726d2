"""Mapping freely typed values to the entries of a reference list.

Token-level repair: every distinct token of the values is joined to the
vocabulary of the reference list by edit distance (an equi-join on deletion
variants, verified afterwards), and the repaired tokens of a value are combined
with soft TF-IDF to rank complete entries. One score decides, against one
threshold; the best entry must be the only one.

Everything runs on the distinct values, and tokens on the distinct tokens, so the
cost follows the variety of spellings and not the number of records.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.session import materialize


@dataclass(frozen=True)
class Script:
    """How a language is written, for all lists of a run.

    ``keys``: letters under the keys of another keyboard, and the keys; ``fold``:
    letters written in two ways; ``doubled``: a letter that may be doubled;
    ``particles``: letters that may be put before a word.
    """

    keys: tuple[str, str] = ("", "")
    fold: tuple[str, str] = ("", "")
    doubled: str = ""
    particles: str = ""

    def full(self, token: Column) -> Column:
        x = F.translate(F.lower(token), *self.fold) if self.fold[0] else F.lower(token)
        return F.regexp_replace(x, self.doubled * 2, self.doubled) if self.doubled else x

    def stem(self, token: Column) -> Column:
        """:meth:`full` without one or two particles before at least three letters."""
        x = self.full(token)
        return F.regexp_replace(x, rf"^[{self.particles}]{{1,2}}(?=\p{{L}}{{3,}})", "") if self.particles else x

    def typed(self, text: Column) -> Column:
        """The text as it was meant if it was typed on the other keyboard."""
        if not self.keys[0]:
            return text
        other, own = self.keys
        letters = "".join(c for c in own if c.isalpha())
        return F.when(~text.rlike(f"[{letters}]") & text.rlike("[a-zA-Z]{2}"), F.translate(F.lower(text), other, own)).otherwise(text)


@dataclass(frozen=True)
class ListProfile:
    """What is said around the names of one reference list.

    ``generic``: words that name no subject (types of body, prepositions);
    ``marked``: words that name a kind of body, which must then agree;
    ``asides``: patterns of remarks added to a name.
    """

    generic: tuple[str, ...] = ()
    marked: tuple[str, ...] = ()
    asides: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Rules:
    """Parameters of the score, fractions all.

    ``least``: score from which an entry is accepted; ``near``: similarity from which
    two words are taken for one, ``plain`` the same for generic words; a word is repaired
    to its nearest words, ``slack`` apart at most, ``own`` for a word of the list; a word
    that may also be a subject names a kind of body from ``clear`` on; ``short``: what an
    entry none of whose words is in the value would lose; ``late``: what it loses for
    each of its first words that the value passes over; ``kind``: what it loses if the
    value lacks the word for its kind of body. A number weighs ``number`` words.
    """

    least: float = 0.72
    near: float = 0.6
    plain: float = 0.5
    slack: float = 0.3
    own: float = 0.25
    clear: float = 0.7
    late: float = 0.05
    short: float = 0.3
    kind: float = 0.15
    number: float = 2.0


_BROKEN = r"(…|\.\.+)[\s\p{Z}\p{Cf}]*$"


def _clean(text: Column, profile: ListProfile, script: Script) -> Column:
    """Invisible characters and asides off, one kind of space, wrong keyboard undone."""
    x = F.regexp_replace(text, r"[\p{Cf}\p{Cc}&&[^\t\n\r]]", "")
    x = F.regexp_replace(x, r"[\s\p{Z}]+", " ")
    x = script.typed(F.regexp_replace(x, r"^ | $", ""))
    x = F.regexp_replace(x, r"^[\s*:;.…\-–]+|[\s*:;…\-–]+$", "")
    for aside in profile.asides:
        x = F.regexp_replace(x, aside, "")
    return F.regexp_replace(x, r"^[\s\"“”(\[]+|[\s\"“”)\]*,:;\-–]+$", "")


def _tokens(clean: Column) -> Column:
    """Words and numbers; quotes inside a word belong to it, as does a final geresh."""
    found = F.regexp_extract_all(clean, F.lit(r"(\p{N}+|\p{L}[\p{L}\p{M}]*(?:[\"'״׳][\p{L}\p{M}]+)*['׳]?)"), 1)
    return F.transform(found, lambda t: F.translate(F.regexp_replace(t, "[׳]", "'"), '"״', ""))


def _without_one(form: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.concat(F.substring(form, F.lit(1), i - 1), F.substring(form, i + 1, F.length(form))))


def _deletions(form: Column) -> Column:
    """The form and every form with one letter less, from five letters on with two
    letters less (numbers and words of one or two letters stay whole)."""
    one = _without_one(form)
    two = F.flatten(F.transform(one, _without_one))
    return (
        F.when((F.length(form) < 3) | form.rlike(r"\p{N}"), F.array(form))
        .when(F.length(form) < 5, F.array_distinct(F.concat(F.array(form), one)))
        .otherwise(F.array_distinct(F.concat(F.array(form), one, two)))
    )


def _spread(listed: DataFrame, keep: list[str], script: Script) -> DataFrame:
    """(keep, pos, width, kind, form) of the words in ``tokens``: each full, without
    particles, and as it could be part of a space lost or misplaced: kind ``pair`` holds
    single words and neighbours written together."""
    words = listed.select(*keep, F.posexplode("tokens").alias("pos", "t"), F.expr("size(tokens)").alias("n"), "tokens")
    after = F.get("tokens", F.col("pos") + 1)
    full = script.full(F.col("t"))
    held = lambda width, kind, form: F.struct(F.lit(width).alias("width"), F.lit(kind).alias("kind"), form.alias("form"))
    forms = F.array(held(1, "full", full), held(1, "stem", script.stem(F.col("t"))), held(1, "pair", full), held(2, "pair", script.full(F.concat("t", after))))
    return words.select(*keep, "pos", "n", F.inline(forms)).where("form is not null")


def _repairs(forms: DataFrame, vocabulary: DataFrame, near: float) -> DataFrame:
    """(field, kind, form, target, sim, share): distinct forms joined to the vocabulary.

    Words meet on the variants they share after up to two letters are left out of each,
    so within two edits; their distance is the number of letters inserted, left out,
    replaced or exchanged with a neighbour, and ``sim`` is 1 - distance / length. Forms of
    pairs meet exactly. Forms of kind ``cut`` meet the words that begin with them, and
    ``share`` says which part of the word is there."""
    # a form longer than any word of the list by more than two letters is near none
    longest = vocabulary.agg(F.max(F.length("form"))).head()[0] or 0
    whole = lambda df, name: df.where("kind <> 'cut'").select("field", "kind", F.col("form").alias(name)).where(F.length(name) <= longest + 2).distinct().withColumn("variant", F.explode(F.when(F.col("kind") == "pair", F.array(name)).otherwise(_deletions(F.col(name)))))
    met = whole(forms, "form").join(whole(vocabulary, "target"), ["field", "kind", "variant"]).groupBy("field", "kind", "form", "target").agg(F.max(F.length("variant")).alias("common"))
    apart = F.levenshtein("form", "target")
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    swapped = (apart == 2) & (letters("form") == letters("target"))
    # three or four edits, most of them letters put in or left out, are two with exchanges
    lost = F.length("form") + F.length("target") - 2 * F.col("common")
    moved = (apart == 3) & (lost <= 4) | (apart == 4) & (lost == 4)
    edits = F.when(swapped, 1).when(moved, 2).otherwise(apart)
    sim = F.when(F.col("kind") == "pair", 0.95).otherwise(1 - edits / F.greatest(F.length("form"), F.length("target")))
    met = met.select("field", "kind", "form", "target", sim.alias("sim"), F.lit(1.0).alias("share")).where(F.col("sim") >= near)
    begin = vocabulary.where("kind = 'full'").select("field", F.col("form").alias("target"), F.explode(F.expr("transform(sequence(1, greatest(length(form) - 1, 1)), i -> left(form, i))")).alias("form")).where("length(form) < length(target)")
    cut = forms.where("kind = 'cut'").select("field", "form").distinct().join(begin.distinct(), ["field", "form"])
    return met.unionByName(cut.select("field", F.lit("cut").alias("kind"), "form", "target", F.lit(1.0).alias("sim"), (F.length("form") / F.length("target")).alias("share")))


def map_to_lists(values: DataFrame, entries: DataFrame, profiles: dict[str, ListProfile], script: Script = Script(), rules: Rules = Rules()) -> DataFrame:
    """(field, raw_value, canonical_value, score): one row per distinct value of
    ``values`` (field, value) that is neither null nor blank, mapped to the entries
    (field, entry) of its field; '' where no entry is meant.

    The score of an entry is the weight of its words found in the value, each times the
    similarity of the repair, over the weight of all words of the value; a word that
    nothing explains weighs like the rarest, a number twice that. Weights are inverse
    document frequencies over the list; generic words weigh nothing. The score falls a
    little with the part of the entry that the value does not name. The last word of a
    value may be broken off: behind another word, or of two letters before an ellipsis,
    it stands for its part of any word that begins so. The entry with the
    highest score is meant if it reaches ``rules.least`` and no other has the same.

    Bounds: words of three and four letters are repaired within one deletion on each
    side, longer ones within two; a word farther from its target counts as unexplained.
    Ties and repeated rows do no harm; an empty list maps everything to ''; an empty
    table gives no rows. Nothing is broadcast by hand: the planner decides by size.
    """
    spark = values.sparkSession
    seen_field = F.col("field")

    def cleaned(text: Column) -> Column:
        out = _clean(text, ListProfile(), script)
        for name, profile in profiles.items():
            out = F.when(seen_field == name, _clean(text, profile, script)).otherwise(out)
        return out

    words = [(name, w, w in p.marked) for name, p in profiles.items() for w in (*p.generic, *p.marked)]
    generic = spark.createDataFrame(words, "field string, word string, marked boolean")
    stem = script.stem(F.col("word"))
    generic = generic.select("field", F.explode(F.array(F.struct(F.lit("full").alias("kind"), script.full(F.col("word")).alias("target")), F.struct(F.lit("stem").alias("kind"), script.full(F.col("word")).alias("target")), F.struct(F.lit("stem").alias("kind"), stem.alias("target")))).alias("x"), F.when(F.col("marked"), stem).alias("mark"))
    generic = generic.select("field", "x.kind", "x.target", "mark").groupBy("field", "kind", "target").agg(F.max("mark").alias("mark"))

    # the lists: weight of every word, and what a spelling of it gives
    ref = entries.select("field", "entry").where(F.col("entry").rlike(r"[^\s\p{Z}\p{Cf}]")).distinct()
    ref = ref.withColumn("tokens", _tokens(_clean(F.col("entry"), ListProfile(), script))).where(F.size("tokens") > 0)
    posted = materialize(_spread(ref, ["field", "entry"], script), "posted")
    known = posted.where("kind <> 'pair'").join(generic, (posted["field"] == generic["field"]) & (posted["kind"] == generic["kind"]) & (posted["form"] == generic["target"]), "left").groupBy(posted["field"], "entry", "pos").agg(
        F.max(generic["target"].isNotNull()).alias("plain"), F.max("mark").alias("mark"), F.max(F.when(posted["kind"] == "stem", F.col("form"))).alias("stem")
    )
    known = materialize(known, "known")
    # generic words as they stand in the list, with their particles
    own = posted.where("kind = 'full'").join(known.where("plain"), ["field", "entry", "pos"]).select("field", "kind", F.col("form").alias("target"), "mark").distinct()
    generic = materialize(generic.unionByName(own).groupBy("field", "kind", "target").agg(F.max("mark").alias("mark")), "generic")
    frequency = known.groupBy("field", "stem").agg(F.countDistinct("entry").alias("df"))
    total = known.groupBy("field").agg(F.countDistinct("entry").alias("of"))
    idf = F.log(1 + F.col("of") / F.col("df")) / F.log(1 + F.col("of"))
    weight = F.when(F.col("plain"), 0.0).otherwise(idf * F.when(F.col("stem").rlike(r"\p{N}"), rules.number).otherwise(1.0))
    weights = known.join(frequency, ["field", "stem"]).join(total, "field").select("field", "entry", "pos", weight.alias("w"), "mark")
    ahead = Window.partitionBy("field", "entry").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    weights = materialize(weights.select("field", "entry", "pos", "w", "mark", F.coalesce(F.sum((F.col("w") > 0).cast("int")).over(ahead), F.lit(0)).alias("rank")), "weights")
    shape = weights.groupBy("field", "entry").agg(F.sum("w").alias("mass"), F.array_sort(F.collect_set("mark")).alias("marks"))
    w = weights.select("field", "entry", F.col("pos").alias("at"), "w", "rank")
    targets = posted.select("field", "entry", "kind", F.col("form").alias("target"), "width", F.explode(F.sequence("pos", F.col("pos") + F.col("width") - 1)).alias("at"))
    targets = targets.join(w, ["field", "entry", "at"]).groupBy("field", "entry", "kind", "target", "width").agg(F.sum("w").alias("w"), F.min("rank").alias("rank")).where("w > 0").withColumnRenamed("width", "ewidth")
    targets = materialize(targets, "targets")

    # distinct values, numbered, so that what follows carries numbers and not texts
    raw = values.select("field", F.col("value").alias("raw_value")).where(F.col("raw_value").rlike(r"[^\s\p{Z}\p{Cf}]")).distinct()
    raw = raw.withColumn("tokens", _tokens(cleaned(F.regexp_replace("raw_value", _BROKEN, "")))).withColumn("broken", F.col("raw_value").rlike(_BROKEN))
    raw = materialize(raw.withColumn("vid", F.monotonically_increasing_id()), "values")
    spread = _spread(raw.where(F.size("tokens") > 0), ["field", "vid", "broken"], script)
    last = spread.where("kind = 'full' and pos = n - 1 and (n > 1 or broken and length(form) > 1)").withColumn("kind", F.lit("cut"))
    forms = materialize(spread.unionByName(last).drop("broken"), "forms")
    vocabulary = targets.select("field", "kind", F.col("target").alias("form")).unionByName(generic.select("field", "kind", F.col("target").alias("form"))).distinct()
    repairs = materialize(_repairs(forms, vocabulary, rules.plain), "repairs")

    # each word of a value is taken for what it is nearest to: a generic word, which may
    # name a kind of body, or a subject; and weighs so much if no entry explains it
    subjects = targets.select("field", "kind", "target").distinct().withColumn("subject", F.lit(True))
    generic = generic.withColumn("generic", F.lit(True))
    cuts = generic.where("kind = 'full'").select("field", F.lit("cut").alias("kind"), "target", F.lit(None).cast("string").alias("mark"), "generic")
    near = repairs.join(generic.unionByName(cuts), ["field", "kind", "target"], "left").join(subjects, ["field", "kind", "target"], "left")
    near = near.where("kind <> 'pair'").groupBy("field", "kind", "form").agg(F.max(F.when(F.col("generic"), F.struct("sim", "mark"))).alias("g"), F.max(F.when(F.col("subject") & (F.col("sim") >= rules.near), F.col("sim"))).alias("s"))
    heard = forms.where("kind <> 'pair'").join(near, ["field", "kind", "form"], "left").withColumn("whole", F.col("kind") != "cut")
    heard = heard.groupBy("field", "vid", "pos", "n").agg(F.max(F.when(F.col("whole"), F.col("g"))).alias("g"), F.max(F.when(F.col("whole"), F.col("s"))).alias("s"), F.max(~F.col("whole") & F.col("g").isNotNull()).alias("begun"), F.max(F.when(F.col("kind") == "full", F.col("form"))).alias("form"))
    g, s = F.coalesce("g.sim", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    generic_word = (g > 0) & (g >= s) & ((g >= rules.clear) | (s == 0) | F.col("g.mark").isNull())
    lone = F.when(F.col("begun"), 0.0).when(generic_word, 1 - g).when(F.col("form").rlike(r"\p{N}"), rules.number).when(F.length("form") > 1, 1.0).when((F.col("pos") == F.col("n") - 1) & (F.col("n") > 1), 0.0).otherwise(0.3)
    heard = materialize(heard.select("field", "vid", "pos", F.when(generic_word, g).otherwise(s - F.when(s == 1, rules.own).otherwise(rules.slack)).alias("from"), F.when(generic_word, F.col("g.mark")).alias("mark"), lone.alias("lone")), "heard")
    whole = heard.groupBy("field", "vid").agg(F.sum("lone").alias("lone"), F.array_sort(F.collect_set("mark")).alias("named"))

    # soft TF-IDF: for each word of the value its best match in each entry, then sums.
    kinds = targets.unionByName(targets.where("kind = 'full'").withColumn("kind", F.lit("cut")))
    hits = forms.drop("n").join(repairs, ["field", "kind", "form"]).join(kinds, ["field", "kind", "target"]).where((F.col("sim") >= rules.near) & ((F.col("kind") != "pair") | (F.col("width") + F.col("ewidth") > 2)))
    hits = hits.select("field", "vid", "entry", "rank", "width", "sim", (F.col("w") * F.col("share") / F.col("width")).alias("w"), F.posexplode(F.sequence("pos", F.col("pos") + F.col("width") - 1)).alias("part", "pos"))
    # each word of the value once, then each word of the entry once
    hits = hits.join(heard, ["field", "vid", "pos"]).where("sim >= from").repartition("field", "vid", "entry")
    gain = lambda *also: F.max(F.struct(F.round((2 * F.col("sim") - 1) * F.col("w"), 9).alias("net"), "sim", "w", *also)).alias("x")
    pair = ["field", "vid", "entry"]
    hits = hits.groupBy(*pair, "pos", "lone").agg(gain((-F.col("rank")).alias("rank"), "part")).select(*pair, "pos", "lone", "x.sim", "x.w", (-F.col("x.rank")).alias("rank"), "x.part")
    hits = hits.groupBy(*pair, "rank", "part").agg(gain("lone"))
    hits = hits.groupBy(*pair).agg(F.sum(F.col("x.sim") * F.col("x.w")).alias("got"), F.sum("x.w").alias("met"), F.sum("x.lone").alias("explained"), F.min("rank").alias("rank"))
    judged = hits.join(shape, ["field", "entry"]).join(whole, ["field", "vid"])
    named = F.size(F.array_except("named", "marks"))
    exact = F.col("got") / (F.col("met") + F.col("lone") - F.col("explained") + named)
    score = exact * (1 - rules.short * (1 - F.least(F.lit(1.0), F.col("met") / F.col("mass")))) - rules.kind * F.size(F.array_except("marks", "named")) - rules.late * F.least(F.col("rank"), F.lit(3))
    judged = judged.select("vid", "entry", F.round(score, 6).alias("score")).where(F.col("score") >= rules.least)
    best = judged.groupBy("vid").agg(F.max("score").alias("score"), F.collect_list(F.struct("score", "entry")).alias("all"))
    top = F.filter("all", lambda x: x["score"] == F.col("score"))
    chosen = best.select("vid", "score", top.alias("top")).where(F.size("top") == 1).select("vid", "score", F.col("top")[0]["entry"].alias("entry"))
    out = raw.select("field", "vid", "raw_value").join(chosen, "vid", "left")
    return out.select("field", "raw_value", F.coalesce("entry", F.lit("")).alias("canonical_value"), F.coalesce("score", F.lit(0.0)).alias("score"))


def map_to_list(values: DataFrame, value: str, entries: DataFrame, entry: str, profile: ListProfile, script: Script = Script()) -> DataFrame:
    """:func:`map_to_lists` for one field: (raw_value, canonical_value, score)."""
    one = F.lit("").alias("field")
    out = map_to_lists(values.select(one, F.col(value).alias("value")), entries.select(one, F.col(entry).alias("entry")), {"": profile}, script)
    return out.select("raw_value", "canonical_value", "score")


@dataclass(frozen=True)
class Field:
    """A freely typed column of some records, and the list it should come from."""

    name: str
    records: DataFrame
    record_id: str
    value: str
    entries: DataFrame
    entry: str
    profile: ListProfile


def map_records(*fields: Field, script: Script = Script()) -> DataFrame:
    """(field_name, record_id, raw_value, canonical_value) of each record whose value
    is not null, not blank and not exactly an entry; distinct rows."""
    typed, listed = None, None
    for f in fields:
        name = F.lit(f.name).alias("field")
        t = f.records.select(name, F.col(f.record_id).cast("bigint").alias("record_id"), F.col(f.value).alias("value")).where(F.col("value").rlike(r"[^\s\p{Z}\p{Cf}]") & F.col("record_id").isNotNull())
        e = f.entries.select(name, F.col(f.entry).alias("entry")).where("entry is not null").distinct()
        typed, listed = (t, e) if typed is None else (typed.unionByName(t), listed.unionByName(e))
    typed = typed.join(listed.withColumnRenamed("entry", "value"), ["field", "value"], "left_anti").distinct()
    mapping = map_to_lists(typed, listed, {f.name: f.profile for f in fields}, script).withColumnRenamed("raw_value", "value")
    return typed.join(mapping, ["field", "value"]).select(F.col("field").alias("field_name"), "record_id", F.col("value").alias("raw_value"), "canonical_value")
