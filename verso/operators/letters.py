"""Fields of letters from transcript lines: salutation, addressee, subject, body, contact, sender."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed patterns -----------------------------------------------------------------------------
LEAD = r"^(?:\S{1,2}\s+)?[^\p{L}\p{N}_]*"
SALUTATION = LEAD + r"(?:با\s*سلام|باسلام|سلام\s*علیکم|سلام\s*و\s*احترام|احتراما|احتراماً)|^[^\p{L}\p{N}_]*\S{0,2}\s*سلام[^\p{L}\p{N}_]*$"
ADDRESSEE = "جناب|سرکار|ریاست|محترم|حضور|" + LEAD + r"به\s*[:：]"
SUBJECT = LEAD + r"موضوع\s*[:：]\s*(.+)$"
CONTACT = r"(?i)آدرس|نشانی|تلفن|تلفکس|فکس|نمابر|کد\s*پستی|صندوق\s*پستی|ایمیل|پست\s*الکترونیک|e-?mail|www\.|https?://|@|وب\s*سایت"
HEADER = LEAD + r"(?:شماره|تاریخ|پیوست|بسمه|باسمه|به\s*نام\s*خدا|بسم)|(?:شماره|تاریخ|پیوست)\s*[:：]|بسمه|باسمه|به\s*نام\s*(?:خدا|او|آن|حق)"
ORGANISATION = "شرکت|سازمان|اداره|وزارت|دانشگاه|بانک|موسسه|مؤسسه|گروه|شهرداری|دفتر|هلدینگ|انجمن|کانون|مجتمع"
HEAD_ORGANISATION = ORGANISATION + "|صنایع|تعاونی"
OPENING = ("سلام", "باسلام", "احتراما", "احتراماً")
REGISTRATION = r"(?:شماره\s*ثبت|ش\s*\.?\s*ث|ثبت)\s*[:：.]?\s*([0-9]{3,12})"
# ------------------------------------------------------------------------------------------------


def letter_fields(lines: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """(page, is_letter, sender, receiver, subject, body_text, contact_info) from lines in reading order.

    `lines` is (page, line, text, y0, page_height, conf). Above the salutation the lines that are no
    subject are numbered from the nearest on: the receiver is the first that fits, unless a heading stands
    nearer, and the next one too where it is worded as an address.
    """
    t = F.trim("text")
    opening = F.slice(F.transform(F.split(t, r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_‌]", "")), 1, 3)
    polite = F.exists(F.sequence(F.lit(1), F.size(opening)), lambda i: (F.element_at(opening, i) == "احترام") & ((i == 1) | (F.element_at(opening, F.greatest(i - 1, F.lit(1))) != "با")))
    rows = lines.select(
        page, "line", t.alias("t"), "y0", "page_height", "conf", (t.rlike(SALUTATION) | F.arrays_overlap(opening, F.array(*map(F.lit, OPENING))) | polite).alias("sal"),
        t.rlike(SUBJECT).alias("subj"), t.rlike(HEADER).alias("head"), t.rlike(ADDRESSEE).alias("addr"), t.rlike(CONTACT).alias("cont"), t.rlike(ORGANISATION).alias("org"),
    )
    whole = Window.partitionBy(page)
    bottom = F.col("cont") & (F.col("y0") > F.col("page_height") * 0.66)
    rows = rows.withColumns(
        {"n": F.count(F.lit(1)).over(whole), "at": F.row_number().over(whole.orderBy("line")) - 1}
    ).withColumns({"sal_at": F.min(F.when(F.col("sal"), F.col("at"))).over(whole), "c_at": F.min(F.when(bottom, F.col("at"))).over(whole)})
    rows = rows.withColumn("end", F.coalesce("sal_at", F.least("n", F.lit(6))))
    # The addressee: candidates above the salutation that are no subject lines, nearest first.
    up = rows.filter((F.col("at") < F.col("end")) & ~F.col("subj"))
    near = Window.partitionBy(page).orderBy(F.desc("at"))
    fits = F.when(F.col("sal_at").isNotNull(), F.lit(True)).otherwise(F.col("addr")) & (F.col("conf") >= least)
    stop = F.col("head") | (~fits & F.col("sal_at").isNotNull())
    up = up.withColumn("walk", F.row_number().over(near))
    first = up.groupBy(page).agg(F.min(F.when(stop, F.col("walk"))).alias("stop"), F.min(F.when(fits & ~F.col("head"), F.col("walk"))).alias("first"))
    first = first.filter(F.col("first").isNotNull() & (F.col("stop").isNull() | (F.col("first") < F.col("stop"))))
    pair = up.join(first, page).filter((F.col("walk") == F.col("first")) | ((F.col("walk") == F.col("first") + 1) & F.col("addr") & ~F.col("head") & (F.col("conf") >= least)))
    receivers = pair.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "\n").alias("receiver"), F.min("at").alias("recv_at"))
    rows = rows.join(receivers, page, "left")
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("at", "t")))), lambda x: x["t"]), "\n")
    body = (F.col("at") >= F.col("sal_at")) & ~F.col("subj") & (F.col("c_at").isNull() | (F.col("c_at") <= F.col("sal_at")) | (F.col("at") < F.col("c_at")))
    contact = (F.col("at") >= F.col("c_at")) & (bottom | ((F.col("at") > F.col("c_at")) & F.col("t").rlike(r"\d{4,}|@")))
    sender = F.col("org") & ~F.col("head") & ~F.col("addr") & (F.col("at") < F.coalesce("recv_at", "end"))
    out = rows.groupBy(page).agg(
        F.nullif(joined(contact), F.lit("")).alias("contact_info"),
        F.first("receiver").alias("receiver"),
        F.min_by(F.when(F.col("subj"), F.trim(F.regexp_extract("t", SUBJECT, 1))), F.when(F.col("subj"), F.col("at"))).alias("subject"),
        F.nullif(joined(body), F.lit("")).alias("body_text"),
        F.min_by(F.when(sender, F.col("t")), F.when(sender, F.col("at"))).alias("sender"),
        (F.max(F.col("sal_at").isNotNull()) | F.max(F.col("receiver").isNotNull())).alias("is_letter"),
    )
    keep = lambda c: F.when(F.col("is_letter"), F.col(c)).alias(c)
    return out.select(page, "is_letter", *(keep(c) for c in ("sender", "receiver", "subject", "body_text", "contact_info")))


def letterhead(words: DataFrame, page: str, least: float = 0.80) -> DataFrame:
    """(page, sender, registration_number): from lines whose worst word is confident; the number in ASCII digits."""
    lines = words.groupBy(page, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]), " ").alias("t"), F.min("conf").alias("c")
    )
    lines = lines.filter(F.col("c") >= least).withColumn("reg", F.regexp_extract(F.translate("t", "۰۱۲۳۴۵۶۷۸۹", "0123456789"), REGISTRATION, 1))
    number, org = F.col("reg") != "", F.col("t").rlike(HEAD_ORGANISATION) & (F.col("reg") == "")
    return lines.groupBy(page).agg(
        F.min_by(F.when(org, F.trim("t")), F.when(org, F.col("line"))).alias("sender"), F.min_by(F.when(number, F.col("reg")), F.when(number, F.col("line"))).alias("registration_number")
    )
