"""Intent of a question, state views and status facts, and keyword intensities, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .facts import NARRATIVE_TYPES, protected_domain

# Terms of each intent, their priority among equals, and compound bonuses.
TERMS = {
    "fact": ("哪天", "哪日", "几号", "日期", "具体", "准确", "精确", "生日", "生理期", "经期", "电话", "地址", "名字", "是谁", "多少", "deadline", "due date", "exact", "when was"),
    "recall": ("回顾", "回忆", "总结", "概括", "复盘", "想起来", "记得", "之前聊过", "讲过什么", "发生过什么", "发生的事", "哪些事", "工作台", "recap", "summary"),
    "relation": ("我俩", "我们俩", "我们之间", "关系", "相处", "亲密", "恋爱", "感情", "她对我", "他对我", "在乎", "信任", "靠近", "疏远", "情绪", "感觉", "最近怎么样", "relationship", "between us"),
    "temporal": ("最近", "这几天", "这段时间", "这周", "上周", "昨天", "前天", "今天", "刚才", "刚刚", "上次", "之前", "后来", "之后", "时间线", "timeline", "变化", "趋势", "顺序", "先后", "什么时候"),
}
PRIORITY = {"fact": 4, "relation": 3, "temporal": 2, "recall": 1}
MOVES = ("搬到", "搬家", "迁移", "切到", "部署", "上线")

# Status of work, questions for it, and hints of technical texts.
STATUS = r"(?i)(?:已|未|没|尚未)?(?:上线|部署|发布|落地|合入|完成|做完|跑完|收口|通过)|(?:进行中|进度|跑了|回滚|撤回|结案|暂停|停滞|失败|全绿|验收)"
QUESTION = r"(?i)(?:吗|么|没|是否|怎样|怎么样|如何|到哪|进度|状态|现在|当前|目前|最新|[?？])|\b(?:done|deployed|released|complete|completed|progress|status|current|latest)\b"
HISTORY = ("以前", "过去", "上次", "历史", "当时", "之前", "曾经", "原来", "最初", "old", "previous", "historical", "before", "back then", "used to")
ENGINEERING = ("工程", "编程", "技术", "开发", "运维", "工作进展", "里程碑", "software", "engineering", "programming", "devops")
TECHNICAL = ("任务", "验收", "测试", "代码", "提交", "commit", "push", "分支", "branch", "部署", "上线", "发布", "容器", "container", "服务", "server", "缓存", "cache", "assembly", "filter", "bug", "接口", "api", "mcp")

# Ordered cascades of keywords and their intensities.
SPICY = (
    (("不辣", "not spicy", "no spice"), 0.0),
    (("微辣", "mild spicy"), 0.25),
    (("剁辣椒", "辣椒酱", "hot sauce", "chili sauce"), 0.85),
    (("麻辣", "火辣", "辛辣", "灼烧", "burning"), 0.75),
    (("辣椒", "spicy", "chili", "pepper", "辣"), 0.6),
)
TOUCH = {"touch_rebound": (("回弹", "rebound"), 0.65), "edge_sting": (("硌", "edge_sting", "edge pressure"), 0.55), "cool_surface": (("凉", "cool", "cold"), 0.45)}
# Words of relative times and what stands for them.
RELATIVE = (("前两天", 2, "前后"), ("前几天", 2, "前后"), ("昨晚", 1, "晚"), ("昨天", 1, ""), ("今早", 0, "早上"), ("刚刚", 0, "稍早"), ("刚才", 0, "稍早"), ("近期", None, "这段时间"), ("最近", None, "这段时间"))


def any_of(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def intent(question: Column, slots: Column) -> Column:
    """struct<intent, confidence> by hits of terms, ``slots`` (registered slots that the
    question names count 3 once) and compound bonuses; ``default`` without any."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    hits = lambda words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(q, w))).cast("double")
    has = lambda *words: any_of(q, words)
    bonus = {
        "fact": F.when(slots > 0, 3.0).otherwise(0.0) + F.when(has("哪天", "几号") & has("生理期", "经期"), 2.0).otherwise(0.0),
        "relation": F.when(has("我俩", "我们俩", "我们之间") & has("怎么样", "最近"), 2.0).otherwise(0.0),
        "temporal": F.when(has("什么时候") & has(*MOVES), 2.0).otherwise(0.0) + F.when(has("时间线", "timeline"), 1.5).otherwise(0.0),
    }
    scores = F.array_sort(F.array(*[F.struct((-(hits(w) + bonus.get(k, F.lit(0.0)))).alias("s"), F.lit(-PRIORITY[k]).alias("p"), F.lit(k).alias("k")) for k, w in TERMS.items()]))
    top, second = -scores[0]["s"], -scores[1]["s"]
    sure = F.least(F.lit(0.95), 0.45 + top * 0.10 + (top - second) * 0.05)
    return F.struct(F.when(top > 0, scores[0]["k"]).otherwise("default").alias("intent"), F.when(top > 0, F.round(sure, 3)).otherwise(0.0).alias("confidence"))


def status_view(question: Column) -> Column:
    """historical, current or neutral for a question about the status of work."""
    q = F.lower(F.trim(question))
    return F.when(~q.rlike(STATUS), "neutral").when(any_of(q, HISTORY), "historical").when(q.rlike(QUESTION), "current").otherwise("neutral")


def is_status(content: Column, domain: Column, kind: Column, pinned: Column, protected: Column) -> Column:
    """Whether a record tells the status of technical work."""
    held = pinned | protected | F.lower(F.trim(kind)).isin("permanent", *NARRATIVE_TYPES) | protected_domain(domain)
    engineering = F.exists(domain, lambda x: any_of(F.lower(F.trim(x)), ENGINEERING))
    return ~held & content.rlike(STATUS) & (engineering | any_of(F.lower(content), TECHNICAL))


def spicy(text: Column) -> Column:
    low, out = F.lower(text), F.lit(0.0)
    for words, value in reversed(SPICY):
        out = F.when(any_of(low, words), value).otherwise(out)
    return out


def touch(text: Column) -> Column:
    """struct of the three intensities."""
    low = F.lower(text)
    smooth = F.contains(low, F.lit("键帽")) & any_of(low, ("凹", "顺滑", "smooth"))
    parts = {k: F.when(any_of(low, words), value).otherwise(0.0) for k, (words, value) in TOUCH.items()}
    parts["touch_rebound"] = F.greatest(parts["touch_rebound"], F.when(smooth, 0.4).otherwise(0.0))
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def anchored(text: Column, today: Column) -> Column:
    """Words of relative times as dates, outside of quotes."""
    quote = r"“[^”]*”|「[^」]*」|\"[^\"]*\""
    day = lambda n: F.date_format(F.date_sub(today, n), "yyyy-MM-dd")

    def moved(t: Column) -> Column:
        for word, n, more in RELATIVE:
            t = F.regexp_replace(t, word, more) if n is None else F.replace(t, F.lit(word), F.concat(day(n), F.lit(more)))
        return t

    plain, quotes = F.split(text, quote, -1), F.regexp_extract_all(text, F.lit(quote), F.lit(0))
    return F.array_join(F.transform(plain, lambda t, k: F.concat(moved(t), F.coalesce(F.try_element_at(quotes, k + 1), F.lit("")))), "")


def negated(text: Column, cue: str, words: tuple[str, ...] = ("not", "never", "no", "without"), gap: int = 2) -> Column:
    """Whether a cue in ``text`` stands in a clause where a negation precedes it by ``gap`` words at most."""
    some = "|".join(words)
    return F.lower(text).rlike(rf"\b(?:{some}|[a-z]+n't)(?:\s+[a-z']+){{0,{gap}}}\s+{cue}")
