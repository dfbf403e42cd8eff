"""Word lists, labels and patterns that the screening rules are defined by."""

from __future__ import annotations

# Levels, dimensions, qualities and section headings.
LEVELS = ("低", "中", "高")
DIMENSIONS = (
    ("education", "学历"), ("work_experience", "工作经历"), ("timeline", "时间线"), ("salary", "薪资"),
    ("skill_exaggeration", "技能夸大"), ("vague_language", "表述模糊"), ("professional_match", "专业匹配"),
)
QUALITIES = ("正常", "需复核", "较差")
UNKNOWN = "未知"
NO_FINDING = "无明显风险点"
EDUCATION_HEADINGS = ("教育背景", "教育经历")
WORK_HEADINGS = ("工作经历", "任职经历", "工作经验")
PROJECT_HEADINGS = ("项目经历", "项目经验")
SKILL_HEADINGS = ("专业技能", "个人技能", "技术专长", "技能栈")
SUMMARY_HEADINGS = ("个人优势", "个人评价", "自我评价")
HEADINGS = EDUCATION_HEADINGS + WORK_HEADINGS + PROJECT_HEADINGS + SKILL_HEADINGS + SUMMARY_HEADINGS
SKILL_STARTS = SKILL_HEADINGS + ("擅长",)

# Keywords of lines.
EDUCATION_WORDS = "大学|学院|学校|本科|硕士|博士|大专|中专|研究生"
DUTY_WORDS = "公司|岗位|职责|负责|任|工程师|开发"
ORGANISATION_WORDS = "公司|集团|银行|科技|软件|信息|咨询|有限|股份|中心|研究院"
JOB_WORDS = "工程师|开发|ETL|数据|分析师|架构师|运维|产品|经理|顾问|实施"
PROJECT_WORDS = "项目|系统|平台|中台|报送|集市|数仓|风控|预测性|生产数据|经营分析|数据整合|数据支撑"
COMPANY_WORDS = "有限公司|股份|集团|科技|软件|信息|咨询"
ROLE_WORDS = "工程师|开发|分析师|顾问|经理"

# Keywords of rules.
OTHER_MAJORS = ("会计", "财务", "市场", "营销", "材料", "高分子", "工艺", "工商")
COMPUTING_MAJORS = "计算机|软件|信息|大数据|统计|数学"
VAGUE_EMPLOYER = "某知名|某大型|头部企业|行业龙头"
VAGUE_DUTY = "重要项目|核心产品|关键任务"
STRONG_WORDS = ("精通", "专家级", "顶级", "全面掌握")
MODERATE_WORDS = ("熟练掌握", "深度理解")
TECHNOLOGIES = (
    "sql", "python", "java", "hive", "spark", "flink", "etl", "hadoop", "kettle", "sqoop", "oracle", "mysql", "bi", "flume", "kafka", "doris",
    "clickhouse", "datax",
)
DATA_SKILLS = "sql|python|java|hive|spark|flink|etl|bi|数据"
LEGACY_PHRASES = ("精通", "熟练掌握", "深度理解", "全面掌握")

# Keywords of the profile table.
PROFILE_EDUCATION = "大学|学院|硕士|博士|本科|大专|一本|二本|985|211"
PROFILE_NOT_AFTER = "技能|技术|专长|擅长"
PROFILE_COMPANY_ENDS = "公司|集团|企业|有限|科技|信息|技术|研究所"
PROFILE_SKILL_STARTS = "技能特长|个人技能|专业技能|技术专长"
PROFILE_SKILL_STOPS = "工作经历|项目经验|教育背景|求职意向|自我评价|简历|证书|语言能力"

# Files.
SUFFIXES = (".pdf", ".docx", ".doc", ".xlsx", ".xls", ".txt")
REPORT_NAMES = "风险评估报告|resume_risk_report|推荐表"
PRUNED_ENDS = "extraction_debug"
