"""Template residue and error-page text: documents that hold unfilled placeholders, filler text,
error pages or script notices in place of content.

Three detectors over the whole text, none of which moves a text:

* placeholders: one grammar per delimiter pair. Pairs that have no other use take any identifier; pairs
  that prose, markup or mathematics use, too, take the name of a field only. A hit is discounted if it
  stands in a code block or in backquotes or if its surroundings speak of notations (a tutorial, a job description);
* filler: *repetition* finds a unit of up to 64 letters said over and over, whatever the unit, by comparing
  the letters of a text with themselves at each distance; *pseudo-Latin* starts from the words of the
  standard passage and learns from the corpus which other words keep company with them
  (``learn_filler``: counts in a table of fixed size), so that a run of such words is told by the corpus's own counts;
* error pages: every line is parsed as error message, technical detail, navigation or content, and
  the share of content decides (density); two error lines in a row count in any text.

Null, empty and blank texts are no cases. Repeated rows give repeated verdicts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from docrisk.llm.codepoints import code_points

# Delimiter grammars of unfilled placeholders.
NAME = r"[\p{L}_][\p{L}\p{N}_. -]{0,39}"
FIELD_CN = (
    "姓名|名字|称呼|性别|年龄|生日|公司|单位|企业|机构|部门|团队|职位|岗位|职务|职称|头衔|学校|院校|专业|学历|学位|城市|地点|地址|省份|国家|日期|时间|年份|月份|年月|电话|手机|号码|邮箱|邮件|微信|网址|链接|"
    "标题|名称|正文|描述|摘要|备注|金额|薪资|价格|数量|编号|收件人|候选人|联系人|签名|署名"
)
FIELD_EN = (
    "name|title|role|position|company|employer|organi[sz]ation|department|team|school|university|college|degree|major|city|state|country|address|street|location|date|year|month|time|phone|mobile|telephone|"
    "number|e-?mail|website|url|link|subject|summary|content|desc(?:ription)?|text|message|amount|salary|price|quantity|id|code|project|product|customer|client|candidate|recipient|contact|user|signature|"
    "nom|prénom|poste|société|adresse|ville|vorname|nachname|firma|stelle|nombre|apellidos?|empresa|puesto|fecha"
)
FIELD = rf"(?:\p{{IsHan}}{{0,6}}(?:{FIELD_CN})|(?i:(?:[a-z]+\d{{0,2}}[_. -]?){{0,3}}(?:{FIELD_EN})s?\d{{0,2}}))"
PLACEHOLDER = "|".join([
    # pairs of template languages: any identifier
    rf"\{{\{{\s?{NAME}(?:\|[^}}\n]{{0,30}})?\}}\}}", rf"\$\{{{NAME}\}}", rf"<%=?\s?{NAME}%>", rf"\{{%\s?{NAME}%\}}", rf"\[\[{NAME}\]\]", rf"#\{{{NAME}\}}",
    r"__[A-Z]{2,}(?:_[A-Z]+)*__",
    # pairs with other uses: names of fields; no generics (List<name>), no tags of markup, no percentages, paths or codes of URLs
    rf"(?<![{{$#%\\])(?<!\\[A-Za-z]{{1,20}})\{{\s?{FIELD}\s?\}}(?!\}})", rf"(?<![A-Za-z0-9])<\s?{FIELD}\s?>", rf"«\s?{FIELD}\s?»", rf"‹\s?{FIELD}\s?›", rf"〈{FIELD}〉", rf"#{FIELD}#", rf"@{FIELD}@", rf"\$(?:[A-Z]+_)*(?:(?i:{FIELD_EN}))\$",
    rf"(?<![0-9０-９])%{FIELD}%(?![\\/])", rf"__{FIELD}__", rf"\[(?:(?:Your|Insert|Enter|Add|Type|Company|Candidate|Full)\s[A-Za-z ]{{2,30}}|(?:[A-Z][a-z]+ ){{0,2}}(?i:{FIELD_EN}))\](?!\()",
    # a number is a slot of a format string, unless it counts repetitions in a pattern or stands in a formula
    r"(?<![\])\\^_}$|*+?{])(?<!\\[A-Za-z]{1,20})(?<![^A-Za-z][A-Za-z])\{\d{1,2}\}(?!\})",
    # instructions to fill in
    r"[【\[（(<〔]\s?(?:请(?:填写|输入|补充|替换|选择|在此)|在此(?:输入|填写|处)|此处(?:填写|输入|插入)|待(?:补充|填写|完善|定))[^】\]）)>〕\n]{0,30}[】\]）)>〕]",
    r"(?:TODO|FIXME|TBD)[:：]\s?(?:补充|填写|完善|待)[^\s，。；]{0,12}", r"X{4}年X{2}月(?:X{2}日)?", r"X{2,4}(?:公司|大学|学校|部门|岗位|同学|先生)",
])
# What speaks of notations, before a hit, right behind it and farther behind it.
TUTORIAL_BEFORE = r"(?i:jinja|模板(?:引擎|渲染|语法|变量)|占位|变量|脚本以|语法|写法|泛型|格式串|通配|such as|形如|placeholder|template (?:engine|syntax|tag)|snippet|interpolat|样例|填充段落)"
TUTORIAL_AFTER = r"(?i:[”\"'` ]{0,2}\s?(?:变量|形式|占位|读取|参数|语法|tags?\b|and \[|and \{|snippet|placeholder|样例))"
TUTORIAL_LATER = r"(?i:写法|泛型|格式串|占位符|语法|placeholder|snippet)"
STARTS = r"(?=[{\[<«‹〈#@$%_【（(〔TFX])"  # every grammar begins with one of these
SPEAKING = rf"{STARTS}(?>{PLACEHOLDER})(?!{TUTORIAL_AFTER}|[^\n]{{0,20}}{TUTORIAL_LATER}|`)"

# Words of the standard passage of filler (those that no other language shares as short words), and English function words.
PASSAGE = (
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip "
    "commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum"
).split()
SHORT_OF_PASSAGE = ("sit", "sed", "do", "ut", "et", "ad", "ex", "ea", "in", "eu", "non", "qui", "id", "est")
FUNCTION_WORDS = "the|of|and|to|for|with|by|from|on|at|a|an|is|are|was|were|as|or|that|this|be|has|have|its|their|our"
LATIN_RUN = r"[A-Za-z]+(?:[,.;:]? [A-Za-z]+){4,}"
#: Words are counted in so many buckets, so that neither the counts nor the learned words grow with the corpus.
WORD_BUCKETS = 1 << 20
LEARNED_SHARE, FILLER_SHARE = 0.6, 0.8
#: Repetition: the longest unit, and the fewest letters and times a unit is said. A unit beyond ``LONGEST_PHRASE`` is a sentence,
#: whose repetition is a matter of duplicates unless it calls itself filler.
LONGEST_UNIT, LONGEST_PHRASE, REPEATED_LETTERS, REPEATED_TIMES = 64, 16, 20, 3
ANNOUNCED = re.compile(r"占位|示例|样例|填充|此处|在此|这里|测试|假文|placeholder|dummy|sample|filler|yourtext|texthere|insert", re.I)  # of a unit without its blanks
COMPARED = 1 << 15  # letters compared at a time
# Grammar of the lines of error pages.
ERROR_LINE = "|".join([
    r"[45]\d\d", r"[45]\d\d\s?[-–:]?\s?(?:Internal|Bad|Not|Forbidden|Gateway|Service|Unauthorized|Too|Server|Error)[^，。；]{0,40}", r"HTTP (?:Status|Error)? ?[45]\d\d.{0,40}", r"Error \d+.{0,30}",
    r"(?:非常)?(?:抱歉|很遗憾|对不起|糟糕)[，,！! ]?.{0,24}(?:不存在|删除|走丢|出错|无法|失败|下线|找不到|未找到|失效).{0,12}",
    r"(?:系统|服务器?|网络|数据库|接口|网站|页面|连接)(?:正在|连接|请求|响应|加载)?(?:维护|繁忙|升级|异常|错误|超时|失败|不可用|开小差|走丢|丢失|不存在|无响应).{0,24}",
    r"(?:您|你)?(?:没有|无|暂无)权限.{0,16}", r"(?:会话|登录|登陆|链接|授权|验证码)(?:状态)?(?:已|错误|过期|超时|失效).{0,28}", r"访问过于频繁.{0,20}", r"(?:操作|请求)(?:过于频繁|参数有误|超时|失败|错误).{0,16}",
    r"(?:文件|附件|图片|简历|预览)?(?:下载|预览|上传|加载|转换|打开)(?:失败|超时|出错).{0,24}", r"(?:文件|附件)预览失败.{0,24}", r"该(?:职位|页面|简历|链接|文件|内容|岗位|信息)(?:已|不)(?:经)?(?:下线|删除|过期|失效|关闭|存在|停止|撤下).{0,12}",
    r"(?:请|需要?|本站需要?|您的浏览器|检测到|页面加载中|为了).{0,30}(?:启用|开启|禁用|打开|允许|拦截|支持|过低).{0,12}(?:Java[Ss]cript|JS|脚本).{0,24}", r"(?:您的)?浏览器.{0,16}(?:Java[Ss]cript|脚本).{0,24}",
    r"检测到.{0,20}脚本.{0,20}", r"页面加载中.{0,30}", r"本站需要.{0,6}Java[Ss]cript.{0,24}", r"(?:noscript: ?)?(?:(?:You|This|Please|Loading|To|Your)\b.{0,60}|please )(?:enable|requires?|switch on|turn on|disabled?|allow)\b.{0,20}\b(?:scripts?|Java[Ss]cript|JS)\b.{0,50}",
    r"(?:JavaScript|Scripts?) (?:is|are|must|has|need).{0,40}", r"(?:Oops|Sorry|Whoops)[!,. ].{0,60}", r"(?:The |This )?(?:page|file|document|resource|record)\b.{0,24}(?:not (?:be )?found|no longer|does not exist|unavailable|removed).{0,20}",
    r"Service (?:temporarily )?unavailable.{0,50}", r"Access denied.{0,30}", r"(?:Bad )?Gateway(?: time-?out)?", r"Internal (?:server )?error.{0,20}", r"(?:Your )?session (?:has )?expired.{0,40}", r"You do not have permission.{0,50}",
    r"Traceback \(most recent call last\):?", r"(?:[a-z]+\.)+[A-Z]\w*(?:Exception|Error)\b.{0,80}", r"[A-Z]\w*(?:Error|Exception): .{0,80}", r"ORA-\d+.{0,60}", r"\{\"(?:code|error|status|errno)\":.{0,160}\}", r"很遗憾.{0,20}",
])
SUPPORT_LINE = "|".join([
    r"File \".*\", line \d+.*", r"at [\w.$]+\(.*\)", r"错误(?:码|编号|代码|号).{0,40}", r"(?:Request|Trace|Incident|Error) ?(?:id|ID|code)?[: ].{0,60}", r"trace .{0,50}", r"Your address has been blocked.{0,60}", r"The upstream server.{0,60}",
    r"upstream .{0,60}", r"给您带来不便.{0,12}", r"(?:请|如有|推荐|建议|点击|或)(?:联系|让|完成|使用|返回|稍后|重新|刷新|检查|疑问|升级).{0,36}", r"\d+ ?秒后.{0,20}", r"(?:返回|刷新|首页|重试|联系客服|重新登录)",
    r"(?:[^\s，。；：:,;|>·/]{1,10})(?:(?: {1,3}| ?[|>·/›»] ?)[^\s，。；：:,;|>·/]{1,10}){2,8}", r"Please .{0,60}", r"Try again.{0,40}", r"Go back.{0,40}", r"[-=_*]{3,}",
])
TAGS = r"</?[A-Za-z][A-Za-z0-9]{0,9}[^<>\r\n]{0,40}>"


def _undiscounted_placeholder(text: Column) -> Column:
    body = F.when(text.contains("```"), F.regexp_replace(text, r"(?s)```.*?(?:```|\z)", " ")).otherwise(text)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(SPEAKING))
    free = F.exists(lines, lambda x: x.rlike(rf"(?<!{TUTORIAL_BEFORE}[^\n]{{0,28}})(?<!`)(?:{SPEAKING})"))
    return F.when(text.rlike(SPEAKING), free).otherwise(False)


def learn_filler(texts: DataFrame, text: str) -> np.ndarray:
    """A flag per word bucket: the word keeps company with the words of the standard passage.

    Counted are the runs of five or more Latin words without an English function word: per word those
    that hold a word of the passage, and all. At most ``WORD_BUCKETS`` rows reach the driver.
    """
    runs = texts.where(F.col(text).rlike(LATIN_RUN)).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({LATIN_RUN})"), F.lit(1))).alias("run"))
    plain = runs.where(~F.col("run").rlike(rf"(?i)\b(?:{FUNCTION_WORDS})\b")).select(F.lower("run").alias("run"))
    words = plain.select(F.col("run").rlike(rf"\b(?:{'|'.join(PASSAGE)})\b").cast("int").alias("near"), F.explode(F.array_distinct(F.split("run", "[^a-z]+"))).alias("word"))
    counts = words.where("word <> ''").groupBy(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(WORD_BUCKETS)).cast("int").alias("b")).agg(F.sum("near").alias("near"), F.count("*").alias("n"))
    found = counts.where(F.col("near") >= LEARNED_SHARE * (F.col("n") + 1)).select("b").toArrow().column("b").to_numpy()
    flags = np.zeros(WORD_BUCKETS, bool)
    flags[found] = True
    for w in (*PASSAGE, *SHORT_OF_PASSAGE):
        flags[zlib.crc32(w.encode()) % WORD_BUCKETS] = True
    return flags


@lru_cache(1)
def _alphanumeric() -> np.ndarray:
    flags = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    flags[0x1E] = True  # stands between texts and stays
    return flags


def repeating(texts: list[str]) -> np.ndarray:
    """Which texts say a unit of letters and digits over and over, whatever stands between its letters.

    A text that is periodic with period p equals itself at distance p for a while; so one comparison of all
    texts at once per distance shows the places, of which some in a row make a text worth an exact look.
    """
    codes = code_points(texts)
    owner = np.cumsum(codes == 0x1E) - (codes == 0x1E)
    keep = _alphanumeric()[codes]
    codes, owner = codes[keep], owner[keep]
    short = np.where(codes == 0x1E, np.arange(len(codes)), codes).astype(np.uint16)  # half the bytes; the exact look makes up for what it confuses
    suspects: set[tuple[int, int]] = set()
    same = np.zeros(COMPARED, bool)
    for at in range(0, len(codes), COMPARED - 8):  # pieces that stay in the processor's cache; an overlap holds what lies across their ends
        piece = short[at : at + COMPARED + LONGEST_UNIT]
        for p in range(1, min(LONGEST_UNIT, len(piece) - 1) + 1):
            n = min(COMPARED, len(piece) - p)
            np.equal(piece[:n], piece[p : n + p], out=same[:n])
            same[n:] = False
            fours = same.view(np.uint32) == 0x01010101
            if (places := np.flatnonzero(fours[:-1] & fours[1:])).size:  # any run of eleven, so the shortest wanted, holds two
                suspects.update((i, p) for i in np.unique(owner[at + places * 4]).tolist())
    out = np.zeros(len(texts), bool)
    for i, p in suspects:
        if not out[i]:
            a, b = np.searchsorted(owner, [i, i + 1])
            out[i] = _repeats(codes[a : b - 1], p)
    return out


def _repeats(codes: np.ndarray, p: int) -> bool:
    need = max(REPEATED_LETTERS - p, (REPEATED_TIMES - 1) * p)
    total = np.concatenate([[0], np.cumsum(codes[:-p] == codes[p:])])
    if len(total) <= need or not (full := np.flatnonzero(total[need:] - total[:-need] == need)).size:
        return False
    return p <= LONGEST_PHRASE or any(ANNOUNCED.search("".join(map(chr, codes[a : a + 2 * p]))) for a in full[:: REPEATED_TIMES * p].tolist())


def _pseudo_latin(text: str, flags: np.ndarray, run: re.Pattern, function: re.Pattern) -> bool:
    for m in run.finditer(text):
        if not function.search(m[0]):
            words = re.findall("[a-z]+", m[0].lower())
            if sum(bool(flags[zlib.crc32(w.encode()) % WORD_BUCKETS]) for w in words) >= FILLER_SHARE * len(words):
                return True
    return False


def _filler(text: Column, flags: np.ndarray) -> Column:
    """Texts travel to Python and one flag comes back; ``flags`` are packed to 128 KB."""
    packed = np.packbits(flags).tobytes()

    @F.pandas_udf(BooleanType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        latin, function = re.compile(LATIN_RUN), re.compile(rf"\b(?:{FUNCTION_WORDS})\b", re.I)
        for texts in batches:
            rows = ["" if t is None else t for t in texts]
            latins = np.fromiter((_pseudo_latin(t, table, latin, function) for t in rows), bool, len(rows))
            yield pd.Series(latins | repeating(rows))

    return run(text)


def _line_kind(line: Column) -> Column:
    return F.when(line.rlike(f"^(?:{ERROR_LINE})$"), "e").when(line.rlike(f"^(?:{SUPPORT_LINE})$"), "s").otherwise("c")


def _error_page(text: Column) -> Column:
    plain = F.when(text.contains("<"), F.regexp_replace(text, TAGS, "")).otherwise(text)
    lines = F.filter(F.transform(F.split(plain, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^[\s　]+|[\s　]+$", "")), lambda x: x != "")
    # both rules ask for an error line; looking for one first is cheaper than the kinds of all lines
    possible = plain.rlike(rf"(?m)^[ \t\x0B\f　]*(?:{ERROR_LINE})[ \t\x0B\f　]*$")
    kinds = F.transform(lines, lambda x: F.struct(_line_kind(x).alias("k"), F.length(x).alias("n")))
    content = F.aggregate(kinds, F.lit(0), lambda a, x: a + F.when(x["k"] == "c", x["n"]).otherwise(0))
    # the second of two lines may go on after the error, unless it is only a number that it begins with
    pair = plain.rlike(rf"(?m)^[ \t\x0B\f　]*(?:{ERROR_LINE})\s*^[ \t\x0B\f　]*(?:{ERROR_LINE.split('|', 1)[1]})")
    letters = F.array_join(F.transform(kinds, lambda x: x["k"]), "")
    return F.when(possible, letters.contains("ee") | pair | (letters.contains("e") & (content * 5 <= F.length(text)))).otherwise(False)


def with_residue_kind(df: DataFrame, text: str = "text", flags: np.ndarray | None = None) -> DataFrame:
    """Add ``residue_kind``: ``placeholder``, ``filler``, ``error_page`` or null for a text with content.

    ``flags``: the learned words of filler; they are learned from ``df`` if not given.
    """
    t = F.col(text)
    filler = _filler(t, learn_filler(df, text) if flags is None else flags)
    return df.withColumn(
        "residue_kind",
        F.when(t.isNull() | ~t.rlike(r"[^\s　]"), F.lit(None).cast("string"))
        .when(_undiscounted_placeholder(t), "placeholder").when(filler, "filler").when(_error_page(t), "error_page"),
    )
