"""Word lists, labels, ordinals, patterns and markers that results depend on."""

# The domain terms searched for in a posting (22 terms).
DOMAIN_TERMS = [
    "金融", "银行", "券商", "证券", "基金", "保险", "期货", "信托", "投行", "资管", "理财", "财富",
    "小贷", "消金", "保理", "租赁", "征信", "清算", "支付", "互金", "金融科技", "FinTech",
]

# Education label -> level. The last four labels occur in data without a published
# level and are assigned here.
EDUCATION_LEVELS = {
    "学历不限": 0.0,
    "高中/中专": 1.0,
    "大专": 2.0,
    "本科": 3.0,
    "硕士": 4.0,
    "博士": 5.0,
    "高中": 1.0,
    "中专/中技": 1.0,
    "中专": 1.0,
    "初中及以下": 0.0,
}

# Experience label -> level in years. The last label is an alias seen in data.
EXPERIENCE_LEVELS = {
    "经验不限": 0.0,
    "应届生": 0.0,
    "1年以内": 0.5,
    "1-3年": 2.0,
    "3-5年": 4.0,
    "5-10年": 7.5,
    "10年以上": 12.0,
    "在校/应届": 0.0,
}

# Substring -> site key, tried in this order.
SOURCE_MARKS = [
    (["BOSS", "boss"], "boss"),
    (["前程无忧", "51job"], "51job"),
    (["智联", "Zhaopin"], "zhaopin"),
]

# Texts that stand for "no value".
SENTINELS = ["", "nan", "NaN", "暂无", "[未获取到描述]"]
EMPTY_TAGS = "暂无"
CLOSED_MARKER = "职位已关闭或不存在"

# Parts of a final address that show a redirect to a verification page.
VERIFY_MARKS = ["security-check", "verify"]

# Places of a detail page that may hold the description, tried in this order.
DESCRIPTION_SELECTORS = [
    ".job-sec-text",
    ".job-detail-section .text",
    ".job-sec .text",
    ".job-description",
    ".job-detail .text",
    '[class*="job-sec"] .text',
]

# Column names of the second site's card table.
CARD_COLUMNS = ["岗位名称", "公司名称", "岗位薪资", "岗位要求", "公司位置", "技术要求", "企业信息"]

# Column names of the first site's posting table.
POSTING_NAMES = {
    "title": "职位",
    "company": "公司",
    "raw_salary": "薪资",
    "city": "地区",
    "raw_experience": "经验",
    "raw_education": "学历",
    "company_size": "公司规模",
    "industry": "行业",
    "welfare_tags": "福利标签",
    "skill_tags": "技能标签",
    "description": "职位描述",
    "job_id": "job_id",
}

# Low end, its unit, high end, its unit, period, months paid.
SALARY_PATTERN = (
    r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([kK千万]?)\s*-\s*([0-9]+(?:\.[0-9]+)?)\s*([kK千万]|元)?"
    r"\s*(?:/\s*(天|月|年|day|month|year))?\s*(?:·\s*([0-9]+)薪)?\s*$"
)
WORK_DAYS_PER_MONTH = 21.75

# Three-level salary bands in K per month.
BAND3_LOW, BAND3_HIGH = 8.0, 20.0

# Four flow bands [.., 10) [10, 20) [20, 35] (35, ..).
FLOW_BANDS = ["低薪区 (<10K)", "中薪区 (10-20K)", "高薪区 (20-35K)", "超高薪区 (>35K)"]

# Five bands of a mean salary, closed on the right.
MEAN_BANDS = [(8.0, "≤8K"), (12.0, "8-12K"), (18.0, "12-18K"), (25.0, "18-25K"), (None, ">25K")]

# Coefficients of the published salary equation.
PUBLISHED_EQUATION = {"const": 8.10, "edu_level": 2.81, "exp_level": 1.70, "similarity": 58.00}
