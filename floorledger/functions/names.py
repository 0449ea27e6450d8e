"""Printed room names: normalised, snapped to the vocabulary, classified."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floorledger.functions.lets import let

# The vocabulary of room names, short plan words, look-alike letter pairs, further lexicon words.
WORDS = (
    "KITCHEN TOILET VERANDA VERANDAH BALCONY LIVING DINING DRAWING FAMILY STUDY LOBBY STAIR FOYER PASSAGE STORE SERVANT CLOSET "
    "PLANTER SUNSHADE POWDER PRAYER UTILITY LAUNDRY MASTER GUEST CHILD SHAFT LANDSCAPE GREEN WALK LIFT BATH SUITE PANTRY LOUNGE "
    "ENTRY TERRACE DRESSING CORRIDOR OFFICE GARDEN SERVICE"
).split()
SHORT = "PDR BED VER AOD ODU WIC KIT".split()
LOOKALIKE_PAIRS = "OD DO OQ QO DQ QD EF FE IL LI ER RE BE EB BR RB UV VU CG GC PR RP EI IE EL LE".split()
LEXICON = [*WORDS, *SHORT, *"BEDROOM ROOM HELP OPEN DRY FORMAL DINNING TOILET VERANDA MAID STAFF TOI TLT TOIL TO AC PUJA DUCT VOID DRESS".split()]
DIGIT_FROM, DIGIT_TO = "015862", "OISBGZ"

# Ordered name rules → kind (green: a planter strip).
SPECIAL_RULES = [
    (r"\b(SUN ?SHADE|PLANTER|PLANT|PLANTATION|GREEN|LANDSCAPE|GARDEN|LAWN)\b", "balcony", True),
    (r"\b(K\.? ?VER(ANDAH?)?|KIT\.? ?VER|KITCHEN VER|SERVICE VER)", "balcony", False),
    (r"\b((SERVANT|HELP|MAID|DRIVER|STAFF)S? ?(TOILET|TOI|TO|TLT|BATH|WC)|[HS]\. ?(TOILET|BATH))\b", "bath", False),
    (r"\b((SERVANT|HELP|MAID)S?|DRIVERS? (ROOM|RM|BED)|STAFF BED|S\. ?BED|SBED)\b|^S/A$", "maid", False),
    (r"\b(LOBBY|STAIRS?|STAIRCASE|LIFTS?|HOISTWAY|FIRE CORRIDOR)\b", "other", False),
    (r"\bGYM\b", "gym", False),
    (r"\b(SWIMMING POOL|POOL)\b", "pool", False),
    (r"\bGRAVEL\b", "paving", False),
    (r"^A[./]?C\b|\b(O\.?D\.?U|LEDGE)\b", "shaft", False),
]
NAME_RULES = [
    (r"\b(W\.? ?I\.? ?C\.?|WALK ?-?IN|CLOSET|DRESS|DRESSER|DRESSING)\b", "closet"),
    (r"\b(TOILET|TOIL|TOI|S?TLT|BATH|BATHROOM|WC|W\.C|PDR|POWDER|WASH ?ROOM)\b", "bath"),
    (r"\b(VERANDAH?|VER|BALCONY|BALC|TERRACE|DECK)\b", "balcony"),
    (r"\b(BED|BEDROOM|MASTER|GUEST|CHILD|SUITE|[MGC]BED|[MGC]\. ?ROOM)\b", "bed"),
    (r"\b(PANTRY|DRY ?KIT(CHEN)?|FOOD STORE)\b", "pantry"),
    (r"\b(KITCHEN|KIT)\b", "kitchen"),
    (r"\b(STUDY|LIBRARY|OFFICE|PAINTING)\b", "study"),
    (r"\b(PRAYER|WORSHIP|PUJA)\b", "prayer"),
    (r"\b(FOYER|ENTRY(?! LOUNGE)|ENTRANCE|PASSAGE|CORRIDOR)\b", "foyer"),
    (r"\b(AOD|DUCT|SHAFT|VOID|CHUTE|OPEN TO SKY)\b", "shaft"),
    (r"\b(STORE|UTILITY|LAUNDRY|SERVICE|CLOTH|DRYING|IRON|SHOE|DISH ?WASH)\b", "utility"),
]
# What printed text must be read as, equal to what users' sheets are read as today.
LIVING_DINING = r"\b(DRAWING|LIVING|FAMILY|LOUNGE|DINING)\b"
NOT_A_ROOM = r"\b(MACHINE(?! ROOM)|FRIDGE|FREEZER|D\.?W|F\.?H\.?B|UP|DN|BEAM|SLAB|PIT)\b"
A_ROOM_ALL_THE_SAME = r"\b(BED|TOILET|BATH|KITCHEN|LIVING|DINING|GREEN)\b"
KIND_RULES = [
    (("pool", "water body", "swimming"), "pool"), (("planter",), "planter"), (("lawn", "garden"), "lawn"),
    (("driveway", "drive way", "ramp"), "driveway"), (("paver", "paving", "paved"), "paving"), (("deck",), "deck"),
    (("play",), "play"), (("gym",), "gym"), (("community",), "community"), (("guard", "security"), "guard"),
]
FALLBACK_KINDS = [
    (("bed",), "bed"), (("bath", "toilet", "pdr", "wc"), "bath"), (("veranda", "balcony"), "balcony"), (("kitchen",), "kitchen"),
    (("dining",), "dining"), (("living", "family", "drawing"), "living"), (("study",), "study"), (("closet", "walk in", "walk-in"), "closet"),
    (("shaft", "aod", "duct"), "shaft"), (("utility", "store", "help"), "utility"),
]
BAY_NUMBER = r"^\s*(p-?)?\d+\s*$"


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _letters(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Z]", "")


def _snap_short(tok: Column) -> Column:
    core = F.regexp_replace(tok, r"\.+$", "")

    def like(w: Column) -> Column:
        swaps = [F.substring(core, i, 1) != F.substring(w, i, 1) for i in (1, 2, 3)]
        pairs = [F.concat(F.substring(w, i, 1), F.substring(core, i, 1)).isin(*LOOKALIKE_PAIRS) for i in (1, 2, 3)]
        one = sum((s.cast("int") for s in swaps[1:]), swaps[0].cast("int")) == 1
        return one & (~swaps[0] | pairs[0]) & (~swaps[1] | pairs[1]) & (~swaps[2] | pairs[2])

    hit = F.get(F.filter(_words(SHORT), like), F.lit(0))
    snapped = F.when((F.length(core) == 3) & ~core.isin(*SHORT), F.concat(hit, F.substr(tok, F.lit(4))))
    return F.coalesce(snapped, tok)


def _clean_token(tok: Column) -> Column:
    fix_letters = lambda t: F.when(t.rlike("[A-Z]") & t.rlike(r"\d") & (F.length(_letters(t)) >= 2), F.translate(t, DIGIT_FROM, DIGIT_TO)).otherwise(t)
    fix_number = lambda t: F.when(t.rlike("^[ODQIL0-9]{2,3}$") & t.rlike(r"\d"), F.translate(t, "ODQIL", "00011")).otherwise(t)

    def near(t: Column) -> Column:
        hit = F.get(F.filter(_words([w for w in WORDS if len(w) >= 5]), lambda w: F.levenshtein(t, w, 1) >= 0), F.lit(0))
        return F.when((F.length(t) >= 5) & ~t.isin(*WORDS), F.coalesce(hit, t)).otherwise(t)

    return let(let(let(let(tok, fix_letters), fix_number), near), _snap_short)


def normalise_name(raw: Column) -> Column:
    """Upper case, punctuation to spaces, digit / letter confusions undone, near words snapped to the vocabulary."""
    s = F.regexp_replace(F.upper(raw), r"([A-Z])['’]S\b", "$1S")
    s = F.regexp_replace(s, "[^A-Z0-9.&/]+", " ")
    split = F.flatten(
        F.transform(F.split(s, " "), lambda t: F.when(t.rlike(r"^[A-Z]{2,}\d+$"), F.array(F.regexp_extract(t, r"^([A-Z]{2,})(\d+)$", 1), F.regexp_extract(t, r"^([A-Z]{2,})(\d+)$", 2))).otherwise(F.array(t)))
    )
    toks = F.transform(split, lambda t: F.array_join(F.transform(F.split(t, "/"), _clean_token), "/"))
    return F.trim(F.array_join(toks, " "))


def snap_words(raw: Column) -> Column:
    """Each word of four letters or more to the one lexicon word within ⌊letters / 3⌋ edits; a tie snaps nothing."""
    s = F.regexp_replace(F.upper(raw), "[^A-Z0-9.&/ -]+", " ")

    def snap(tok: Column) -> Column:
        def read(w: Column) -> Column:
            limit = F.floor(F.length(w) / 3).cast("int")
            # words whose length alone is too far off are no candidates; of the rest each distance is taken once
            near = F.filter(_words(LEXICON), lambda lx: F.abs(F.length(lx) - F.length(w)) <= limit)
            dist = F.transform(near, lambda lx: F.struct(F.levenshtein(w, lx).alias("d"), lx.alias("l")))

            def closest(ds: Column) -> Column:
                return let(F.array_min(F.transform(ds, lambda h: h["d"])), lambda best: let(F.filter(ds, lambda h: h["d"] == best), lambda at: F.when((best <= limit) & (F.size(at) == 1), F.get(at, F.lit(0))["l"])))

            return F.when((F.length(w) < 4) | w.isin(*LEXICON), tok).otherwise(F.coalesce(let(dist, closest), tok))

        return let(_letters(tok), read)

    return F.trim(F.array_join(F.transform(F.split(s, r"\s+"), snap), " "))


def trim_name(name: Column) -> Column:
    """Stray tokens at both ends dropped, only when a plan word is left; else as read."""
    keep = lambda t: ~t.rlike("^[A-Z]{1,3}$") | t.isin(*LEXICON) | t.rlike("^[MSHKC]$") | (t == "WC")

    def cut(toks: Column) -> Column:
        kept = F.transform(toks, keep)
        a = F.array_position(kept, F.lit(True))
        b = F.size(toks) - F.array_position(F.reverse(kept), F.lit(True)) + 1
        out = F.when(a > 0, F.slice(toks, a.cast("int"), (b - a + 1).cast("int"))).otherwise(F.array().cast("array<string>"))
        plan = F.exists(out, lambda t: F.exists(F.split(t, "[^A-Z]+"), lambda w: w.isin(*LEXICON)))
        return F.when(plan, F.array_join(out, " ")).otherwise(name)

    return let(F.filter(F.split(name, " "), lambda t: t != ""), cut)


def name_key(s: Column) -> Column:
    """The key two printings of one name share: BED 01 = Bed 1, LIVING & DINING = LIVING+DINING."""
    n = F.regexp_replace(trim_name(normalise_name(s)), r"\b0+(?=\d)", "")
    return F.regexp_replace(n, r"\bAND\b|[^A-Z0-9]", "")


def classify_normalised(n: Column) -> Column:
    """A normalised name → struct(kind, green), or null where it names no room."""

    def read(n: Column) -> Column:
        special = F
        first = True
        for pattern, kind, green in SPECIAL_RULES:
            v = F.struct(F.lit(kind).alias("kind"), F.lit(green).alias("green"))
            special = F.when(n.rlike(pattern), v) if first else special.when(n.rlike(pattern), v)
            first = False
        rule = F
        for i, (pattern, kind) in enumerate(NAME_RULES):
            v = F.struct(F.lit(kind).alias("kind"), F.regexp_instr(n, F.lit(pattern)).alias("at"))
            rule = F.when(n.rlike(pattern), v) if i == 0 else rule.when(n.rlike(pattern), v)
        live_at = F.regexp_instr(n, F.lit(LIVING_DINING))
        live = F.when(F.regexp_extract(n, LIVING_DINING, 1) == "DINING", "dining").otherwise("living")
        plain = let(
            rule,
            lambda r: F.when((live_at > 0) & (r.isNull() | (r["at"] > live_at)), F.struct(live.alias("kind"), F.lit(False).alias("green"))).when(
                r.isNotNull(), F.struct(r["kind"].alias("kind"), F.lit(False).alias("green"))
            ),
        )
        nothing = n.rlike(NOT_A_ROOM) & ~n.rlike(A_ROOM_ALL_THE_SAME)
        return F.when(~nothing, F.coalesce(special, plain))

    return let(n, read)


def classify_room(raw: Column) -> Column:
    """A printed label → struct(kind, green), or null."""
    return classify_normalised(normalise_name(raw))


def guess_kind(name: Column) -> Column:
    """The kind of a typed name: outdoor and common words first, then the printed-name rules, then plain words, else other."""
    n = F.lower(name)
    has = lambda ws: F.greatest(*[n.contains(w) for w in ws], F.lit(False)) if len(ws) > 1 else n.contains(ws[0])
    out = F.when(n.rlike(BAY_NUMBER) | has(("parking", "car park")), "parking")
    for ws, kind in KIND_RULES:
        out = out.when(has(ws), kind)
    out = out.when(has(("reception",)) | (has(("lobby",)) & ~has(("lift",))), "lobby")
    rest = F
    for i, (ws, kind) in enumerate(FALLBACK_KINDS):
        rest = F.when(has(ws), kind) if i == 0 else rest.when(has(ws), kind)
    return F.coalesce(out, classify_room(name)["kind"], rest, F.lit("other"))


def flat_type_of(name: Column, kind: Column) -> Column:
    """TYPE-A ±2736 SFT → "Type A", UNIT A & B → "Unit A & B"; null for any other label."""
    # Fixed value: the printed form of a flat type.
    pattern = r"(?i)\b(type|unit)[\s:-]*([a-z0-9]{1,2}(?:\s*(?:&|\+|and\b)\s*[a-z0-9]{1,2})*)\b"
    word = F.lower(F.regexp_extract(name, pattern, 1))
    letters = F.regexp_replace(F.upper(F.regexp_extract(name, pattern, 2)), r"\s*(?:&|\+|AND)\s*", " & ")
    return F.when((kind == "other") & name.rlike(pattern), F.concat(F.initcap(word), F.lit(" "), letters))


def says_parking(text: Column) -> Column:
    # Fixed value.
    return text.rlike(r"\b(PARKING|DRIVE ?WAY|RAMP)\b")


def says_lobby(text: Column) -> Column:
    # Fixed value: with the misreadings of its letters.
    return text.rlike(r"\bL[O0][B8]{2}Y\b")


# Plan abbreviations of one word, words that name nothing, names that never carry a size.
SYNONYMS = {"VER": "VERANDA", "VERANDAH": "VERANDA", "PDR": "POWDER", "SUNSHADE": "PLANTER", "LIFTS": "LIFT", "TOILETS": "TOILET"}
IGNORED = ("ROOM", "AND", "THE", "CUM")
NO_SIZE_EXPECTED = r"^A[./]?C\b|\b(AOD|DUCT|SHAFT|VOID|CHUTE|O\.?D\.?U|LEDGE|LIFT|STAIRS?|LOBBY|PASSAGE|CORRIDOR)\b"


def _tokens(n: Column) -> Column:
    return F.filter(F.split(n, "[^A-Z0-9]+"), lambda t: t != "")


def _numbers(toks: Column) -> Column:
    return F.transform(F.filter(toks, lambda t: t.rlike(r"^\d{1,2}$")), lambda t: t.cast("int"))


def name_right(printed: Column, got_name: Column, got_kind: Column) -> Column:
    """The traced name is right for the printed one: same kind, a shared number, for the core a shared word stem."""
    stems = lambda toks: F.transform(F.filter(toks, lambda t: t.rlike("^[A-Z]{3,}$")), lambda t: F.substring(t, 1, 4))

    def check(x: Column) -> Column:
        want = classify_normalised(x["p"])["kind"]
        pt, gt = _tokens(x["p"]), _tokens(x["g"])
        nums = _numbers(pt)
        return (
            F.coalesce(want == got_kind, F.lit(False))
            & ((F.size(nums) == 0) | F.arrays_overlap(nums, _numbers(gt)))
            & ((want != "other") | F.arrays_overlap(stems(pt), stems(gt)))
        )

    both = F.struct(normalise_name(printed).alias("p"), normalise_name(got_name).alias("g"))
    return F.coalesce(let(both, check), F.lit(False))


def same_label(truth: Column, read: Column) -> Column:
    """A shared name word (abbreviations undone) and no conflicting number."""

    def words(toks: Column) -> Column:
        w = F.filter(toks, lambda t: t.rlike("^[A-Z]{3,}$") & ~t.isin(*IGNORED))
        table = F.create_map(*[F.lit(v) for kv in SYNONYMS.items() for v in kv])
        return F.transform(w, lambda t: F.coalesce(F.try_element_at(table, t), t))

    clean = lambda s: F.regexp_replace(F.upper(s), r"\(.*?\)", " ")
    first = F.substring_index(read, "\n", 1)
    both = F.struct(_tokens(clean(truth)).alias("a"), _tokens(clean(normalise_name(first))).alias("b"))

    def check(x: Column) -> Column:
        na, nb = _numbers(x["a"]), _numbers(x["b"])
        return F.arrays_overlap(words(x["a"]), words(x["b"])) & ((F.size(na) == 0) | (F.size(nb) == 0) | F.arrays_overlap(na, nb))

    return F.coalesce(let(both, check), F.lit(False))


def reask_reason(source: Column, kind: Column, text: Column, has_dims: Column, green: Column, conf: Column, min_conf: float = 0.6) -> Column:
    """Why a read label is worth asking about again, or null."""
    two_lines = kind.isin("room", "other") & text.contains("\n") & ~has_dims
    return (
        F.when(source == "ai", F.lit(None).cast("string"))
        .when((kind == "dims") & ~has_dims, "unparsed-dims")
        .when(two_lines, "unparsed-dims")
        .when((kind == "room") & ~has_dims & ~green & ~normalise_name(text).rlike(NO_SIZE_EXPECTED), "room-without-dims")
        .when((kind != "other") & (conf < min_conf), "low-confidence")
    )


def montage_rank(source: Column, kind: Column, size_unread: Column, has_dims: Column, reason: Column, glyph_px: Column, w: Column, h: Column) -> Column:
    """How useful asking about a label is, 4 most; 0 = not asked."""
    g = F.coalesce(glyph_px, F.lit(10.0))
    return (
        F.when(source == "ai", 0)
        .when((kind == "room") & size_unread, 4)
        .when((kind == "dims") & has_dims, 3)
        .when(size_unread | (reason.isNotNull() & (reason != "low-confidence")), 2)
        .when((g <= 7) & (kind == "other") & (h >= 1.5 * g) & (w <= 20 * g), 1)
        .otherwise(0)
    )
