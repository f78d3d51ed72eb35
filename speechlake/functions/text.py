"""Text functions as Column builders: normalisation, scores, tokens, ids, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character sets below must equal those of the corpora that the scores are compared with.
ASCII_PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
HAN_PUNCTUATION = "＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､　、〃〈〉《》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏﹑﹔·．！？｡。"
KANA_IGNORED = "、。！？!?，,．.…「」『』（）()　 ・ー"
CN_ENDINGS = "。.!？！?"
JA_ENDINGS = "。.!？！?…」』"


#: Characters whose case folding is not their lower case: to one character, and to several.
_FOLDS = {c: c.casefold() for c in map(chr, range(0x80, 0x1FFFF)) if not 0xD800 <= ord(c) < 0xE000 and c == c.lower() and c != c.casefold()}
_ONE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_MORE = {c: f for c, f in _FOLDS.items() if len(f) > 1 and c != "ß"}


#: What all of those are in: two letters, and everything from the long s on.
_RARE = "[\u00b5\u0149\u017f-\U0010ffff]"


def folded(x: Column) -> Column:
    """Full case folding: lower case, and what folding maps beyond it (ß to ss, long s, final sigma, ligatures)."""
    spread = F.create_map(*[F.lit(t) for pair in (_ONE | _MORE).items() for t in pair])
    # Only texts that may have rare characters are taken apart.
    apart = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(spread, c), c)), "")
    low = F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    return F.when(low.rlike(_RARE), apart(low)).otherwise(low)


def leakage_form(x: Column) -> Column:
    """Case-folded letters and digits only."""
    return F.regexp_replace(folded(x), r"[^\p{L}\p{N}]", "")


def gram_hashes(x: Column, n: int) -> Column:
    """The distinct character n-grams, as 64-bit hashes of their characters."""

    def grams(chars: Column) -> Column:
        one = lambda c, i: F.xxhash64(c, *[F.get(chars, i + k) for k in range(1, n)])
        return F.array_distinct(F.slice(F.transform(chars, one), 1, F.greatest(F.size(chars) - (n - 1), F.lit(0))))

    # A pattern, since splitting would cut characters beyond the basic plane in two. Through a lambda, so that it runs once.
    return F.transform(F.array(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("(?s)."), F.lit(0))), grams)[0]


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance by the reference's length; empty reference: 0 if both are empty, else 1."""
    return F.when(F.length(reference) == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def error_rate_floor(reference: Column, hypothesis: Column) -> Column:
    """The variant that divides by at least 1."""
    return F.levenshtein(reference, hypothesis) / F.greatest(F.length(reference), F.lit(1))


def wer_form(x: Column, lang: str) -> Column:
    """No punctuation, two spaces replaced by one (once), zh as spaced characters, en in lower case."""
    bare = F.replace(F.translate(x, HAN_PUNCTUATION + ASCII_PUNCTUATION, ""), F.lit("  "), F.lit(" "))
    return F.array_join(F.split(bare, ""), " ") if lang == "zh" else F.lower(bare) if lang == "en" else bare


def word_error_rate(truth: Column, hypothesis: Column) -> Column:
    """Word edits by the truth's words; null without words in the truth.

    Each distinct word of the pair becomes a code point of its own (from U+10000 on), so the edit distance of the two
    strings is that of the words, exactly."""
    words = lambda x: F.array_remove(F.split(F.coalesce(x, F.lit("")), r"(?U)\s+"), "")

    def rate(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        known = F.array_distinct(F.concat(a, b))
        spelled = lambda ws: F.decode(F.unhex(F.array_join(F.transform(ws, lambda w: F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "")), "UTF-32")
        return F.when(F.size(a) > 0, F.levenshtein(spelled(a), spelled(b)) / F.size(a))

    # Through a lambda, so that each text is split once.
    return F.transform(F.array(F.struct(words(truth).alias("a"), words(hypothesis).alias("b"))), rate)[0]


def kana_form(x: Column) -> Column:
    return F.translate(x, KANA_IGNORED, "")


def full_width(x: Column) -> Column:
    return F.translate(x, ",!?", "，！？")


def ascii_quotes(x: Column) -> Column:
    return F.translate(x, ";“”‘’", ",\"\"''")


def clean_cn(x: Column) -> Column:
    """No spaces; ends with a full stop unless it ends a sentence; empty stays empty."""
    t = F.regexp_replace(F.replace(x, F.lit(" "), F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "", t).when(F.instr(F.lit(CN_ENDINGS), F.right(t, F.lit(1))) > 0, t).otherwise(F.concat(t, F.lit("。")))


def clean_ja(x: Column) -> Column:
    """Wide spaces as spaces, runs collapsed; ends with a full stop unless it ends a sentence or quote."""
    t = F.trim(F.regexp_replace(F.replace(x, F.lit("　"), F.lit(" ")), r"\s+", " "))
    return F.when(t == "", t).when(F.instr(F.lit(JA_ENDINGS), F.right(t, F.lit(1))) > 0, t).otherwise(F.concat(t, F.lit("。")))


def han_characters(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"([㐀-䶿一-鿿豈-﫿]|[\uD840-\uD888][\uDC00-\uDFFF])"), F.lit(1))


def output_failures(x: Column, vocab: Column) -> Column:
    """Names of what is wrong with a converted text: han, control, replacement_character, oov."""
    return F.array_compact(F.array(
        F.when(F.size(han_characters(x)) > 0, "han"), F.when(x.rlike(r"\p{Cc}"), "control"),
        F.when(F.contains(x, F.lit("�")), "replacement_character"), F.when(F.size(F.array_except(F.split(x, ""), vocab)) > 0, "oov"),
    ))


def output_report(x: Column, vocab: Column) -> Column:
    """struct of what is wrong with a converted text: han, oov (distinct characters, sorted), control (their code points,
    sorted), replaced (places of U+FFFD, from 0)."""
    cells = F.split(x, "")
    controls = F.transform(F.array_distinct(F.regexp_extract_all(x, F.lit(r"(\p{Cc})"), F.lit(1))), lambda c: F.ascii(c))
    places = F.array_compact(F.transform(cells, lambda c, i: F.when(c == "\ufffd", i)))
    return F.struct(F.array_sort(F.array_distinct(han_characters(x))).alias("han"), F.array_sort(controls).alias("control"), places.alias("replaced"), F.array_sort(F.array_except(cells, vocab)).alias("oov"))


def rescored(status: Column, reference: Column, text: Column, score: Column) -> tuple[Column, Column]:
    """(status, score) after a repair: failed rows that have a text and a reference once U+FFFD is gone are scored anew
    and ok, other failed rows stay failed without a score; all others stay as they are."""
    clean, _ = repaired(text)
    again = (status == "failed") & F.coalesce((F.length(clean) > 0) & (F.length(reference) > 0), F.lit(False))
    return F.when(again, F.lit("ok")).otherwise(status), F.when(again, error_rate(reference, clean)).when(status == "failed", F.lit(None).cast("double")).otherwise(score)


def chunk_bytes(text_bytes: Column, seconds: Column, speed: Column, limit: float = 22.0) -> Column:
    """How many bytes of text a chunk may have, so that it and a reference of so many seconds stay within the limit."""
    return F.floor(text_bytes / seconds * (F.lit(limit) - seconds) * speed).cast("long")


def union_frames(ref_frames: Column, gen_frames: Column) -> Column:
    """Frames of a mix of two references: the longer reference and the longest stretch that either makes."""
    return F.greatest(ref_frames, gen_frames)


def characters(x: Column) -> Column:
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.split(x, ""))


def seconds_of(hms: Column) -> Column:
    """HH:MM:SS to seconds; null unless minutes and seconds are below 60."""
    part = lambda i: F.element_at(F.split(hms, ":"), i).cast("int")
    ok = hms.rlike(r"^\d{2}:\d{2}:\d{2}$") & (part(2) < 60) & (part(3) < 60)
    return F.when(ok, part(1) * 3600 + part(2) * 60 + part(3))


def hms_of(seconds: Column) -> Column:
    whole = seconds.cast("long")
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), (whole % 60).cast("long")))


def stable_id(prefix: str, json: Column, newline: bool = False) -> Column:
    """prefix and the first 24 hex digits of the canonical JSON's sha256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(json, F.lit("\n")) if newline else json, 256), 1, 24))


def json_string(x: Column) -> Column:
    """x as canonical JSON text: non-ASCII characters stay, quotes, backslashes and line ends are escaped."""
    out = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t")), F.lit('"'))


def estimated_frames(ref_frames: Column, ref_text: Column, gen_text: Column, speed: Column) -> Column:
    """ref + int(ref / ref bytes * gen bytes / speed); texts under 10 bytes speak at 0.3."""
    slow = F.when(F.octet_length(gen_text) < 10, F.lit(0.3)).otherwise(speed)
    return (ref_frames + F.floor(ref_frames / F.octet_length(ref_text) * F.octet_length(gen_text) / slow)).cast("long")


def allocation(size: Column, over, target: float, fade: float, reference: float) -> tuple[Column, Column]:
    """(share, seconds) of each chunk of a request: by size, of the target and what the fades between chunks take,
    with the reference's seconds on top. over: the window of a request."""
    share = size / F.sum(size).over(over)
    return share, share * (F.lit(target) + F.lit(fade) * (F.count("*").over(over) - 1)) + reference


def pace_verdict(ratio: Column) -> Column:
    return F.when(ratio > 1.15, "slow").when(ratio < 0.87, "fast").otherwise("even")


def finished_prompt(x: Column) -> Column:
    """Ends with '. ' or '。': adds what is missing."""
    done = F.when(F.endswith(x, F.lit(". ")) | F.endswith(x, F.lit("。")), x).when(F.endswith(x, F.lit(".")), F.concat(x, F.lit(" "))).otherwise(F.concat(x, F.lit(". ")))
    return done


def spaced_end(x: Column) -> Column:
    """A space after a last character of one byte."""
    return F.when(F.octet_length(F.right(x, F.lit(1))) == 1, F.concat(x, F.lit(" "))).otherwise(x)


def voice_pieces(x: Column) -> Column:
    """array<struct<voice, text>> of a text with [voice] tags; pieces without a tag get 'main', blank ones go."""
    pieces = F.filter(F.split(x, r"(?=\[\w+\])"), lambda p: F.trim(p) != "")
    voice = lambda p: F.when(p.rlike(r"^\[\w+\]"), F.regexp_extract(p, r"^\[(\w+)\]", 1)).otherwise(F.lit("main"))
    return F.transform(pieces, lambda p: F.struct(voice(p).alias("voice"), F.trim(F.regexp_replace(p, r"\[(\w+)\]", "")).alias("text")))


def repaired(x: Column) -> tuple[Column, Column]:
    """(text without U+FFFD, how many were removed)."""
    out = F.replace(x, F.lit("�"), F.lit(""))
    return out, (F.length(x) - F.length(out)).cast("long")


def key_differences(json: Column, expected: list[str]) -> tuple[Column, Column]:
    """(missing, extra) keys of a JSON object."""
    keys, want = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in expected])
    return F.array_sort(F.array_except(want, keys)), F.array_sort(F.array_except(keys, want))


def frames(duration: Column, rate: int = 24000, hop: int = 256) -> Column:
    """max(1, int(duration * rate / hop))"""
    return F.greatest(F.lit(1), F.floor(duration * rate / hop)).cast("long")
