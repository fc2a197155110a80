"""Thresholds, patterns, word lists and glossaries that results depend on.  Patterns suit Java's regex."""

# fixed values: limits
PAGE_WIDTH, PAGE_HEIGHT = 612, 792
MAX_UNIT_CHARS = 2500
MAX_BATCH_ITEMS = 1
MAX_BATCH_CHARS = 12000
MIN_FONT_SIZE = 4.5
DEFAULT_LINE_HEIGHT = 1.2
LINE_HEIGHT_RANGE = (0.7, 2.0)
FIT_SCALES = (0.9, 0.4)
SPLIT_WINDOW = 80
ATTEMPTS, TIMEOUT_SECONDS, RETRY_SLEEP_SECONDS = 3, 60, 0.5
OUTPUT_SUFFIX = "_zh-CN.pdf"

# fixed values: characters
MATH_LINE = "=<>≤≥∈∥⊤⊂∑µκτδϵαθπ−+*/{}[]()"
MATH_BLOCK = "=∈∥⊤⊂∑µκτδϵαθπ−+*/{}[]()"
CJK_MARKS = "，。！？；：、（）《》【】“”‘’"
CJK_CLOSING = "，。！？；：、）】》”’"

# fixed values: table headers
TABLE_HEADERS = (
    r"\bhyperparameters\b", r"\bvalues\b", r"\bluna-base\b", r"\bluna-large\b", r"\bluna-huge\b", r"\bstage\b", r"\binput shape\b", r"\bcomplexity\b",
    r"\bmethod\b", r"\bbottleneck\b", r"#patches\b", r"#channels\b", r"\bflops\b", r"\bmemory\b", r"\bmib\b", r"\bdataset\b", r"# subjects\b", r"# samples\b",
    r"\bhours of recordings\b", r"\bmontage\b", r"\bvariant\b", r"\bauroc\b", r"\bauprc\b",
)

# fixed values: patterns of blocks
WORD3, WORD2, WORD1 = "[A-Za-z][A-Za-z-]{2,}", "[A-Za-z][A-Za-z-]+", "[A-Za-z][A-Za-z-]*"
NUMBER, DECIMAL = r"\p{Nd}+(?:\.\p{Nd}+)?", r"\p{Nd}+\.\p{Nd}+"
CAPTION = r"(?i)\b(figure|fig\.|table)\s*\p{Nd}+[:.]"
DATASET_PAIR = r"(?i)^Dataset\s+(?:[IVX]+|\p{Nd}+):\s+Dataset\s+(?:[IVX]+|\p{Nd}+)\s+"
TABLE_ROWS = r"(?i)^(query self-attention|patch-wise attention encoder|luna \(latent space attention\)|full-attention|alternating attention)\b"
TABLE_MODULE = r"(?i)^channel-unification module\b"
TABLE_FIRST = r"(?i)^(method|dataset|components)\b"
TABLE_LABEL = "Temporal Encoder"
TABLE_PAIRS = (("Base-to-Novel", "Few-shot"), ("LSCE", "Base", "Novel"))
TABLE_MARKS = "±✓✗"
JOURNAL_BANNER = "IEEE JOURNAL OF"
RUNNING_AUTHORS = r"(?i)\bet al\.\s*:"
VERSION_FOOTER = r"(?i)\b(?:conference|proceedings|workshop|preprint|under review|neurips|iclr|icml|cvpr|eccv|acl|arxiv)\b"
CONFERENCE_HEADER = r"(?i)\b(?:published as|accepted as|under review).{0,40}\b(?:conference paper|workshop paper|ICLR|ICML|NeurIPS|OpenReview)\b"
REFERENCES = r"(?i)^references\b"
APPENDIX = r"(?i)^(?:Append(?:ix|ices)|Technical Appendices|Supplementary Material)\b"
APPENDIX_OR_CHECKLIST = r"(?i)^(?:[A-Z]\s+)?(?:Append(?:ix|ices)|Technical Appendices|Supplementary Material)\b|^NeurIPS Paper Checklist\b"
LETTER_HEADING = r"^[A-Z](?:\.\p{Nd}+)*\s+([A-Z0-9][A-Z0-9 .,,:;()&/\-]*)$"
READING_PRIORITY = r"^[a-z]\s*[=≤<>∈(]"
RECEIVED = ("Received ", "Digital Object Identifier", "©")
MEMBERSHIP = r"\b(?:Member|Fellow|Graduate Student Member),\s+IEEE\b"
AFFILIATIONS, SOURCE_CODE = (" with the ", " is with the "), "source code can be found"
CONTEXT_LABELS = ("where", "satisfies", "such that", "as follows")
DROP_CAP = r"^([IVX]+\.\s+[A-Z][A-Za-z ]+)\s+([A-Z])$"
CAPITAL_WORD = "^[A-Z][A-Z-]+"

# fixed values: emphasis in font names
BOLD_FONTS, ITALIC_FONTS = "bold|medi|cmbx|cmmib", "italic|ital|oblique|cmmi"

# fixed values: glossaries
COMMON_HEADINGS = {
    "abstract": "摘要", "introduction": "引言", "related work": "相关工作", "method": "方法", "methods": "方法", "experiments": "实验", "results": "结果", "discussion": "讨论",
    "conclusion": "结论", "conclusions": "结论", "limitations": "局限性", "references": "参考文献", "acknowledgments": "致谢", "acknowledgements": "致谢",
    "sample complexity": "样本复杂度", "expressive power": "表达能力", "stability": "稳定性", "computational complexity": "计算复杂度", "baselines": "基线方法", "architectures": "架构",
    "stability analysis": "稳定性分析", "implementation details": "实现细节", "additional experiments": "补充实验", "ablation studies": "消融研究",
}
HEADING_PHRASES = {
    "our work": "我们的工作",
    "our work: learnable, efficient, and powerful pes with gnns": "我们的工作：基于GNNs的可学习、高效且强大的位置编码（PEs）",
    "gnns are nonlinear functions of gso eigenvectors": "GNNs是GSO特征向量的非线性函数",
    "pearl: expressive and equivariant positional encoding networks": "PEARL：表达能力强且等变的位置编码网络",
    "our work: random positional encoding network (r-pearl)": "我们的工作：随机位置编码网络（R-PEARL）",
    "comparing pearl to structural pes": "将PEARL与结构化PEs进行比较",
    "proof of proposition 3.1": "命题3.1的证明",
    "proof of corollary 4.4": "推论4.4的证明",
    "basis universality of pearl": "PEARL的基普适性",
    "our work: basis positional encoding networks (b-pearl)": "我们的工作：基位置编码网络（B-PEARL）",
    "relation to eigenvector based encodings": "与基于特征向量的编码的关系",
    "graph classification on social networks": "社交网络上的图分类",
    "graph regression on molecular graphs": "分子图上的图回归",
    "large-scale link prediction on relational databases (relbench)": "关系数据库（RelBench）上的大规模链接预测",
    "pearl is a universal function of eigenvalues": "PEARL是特征值的通用函数",
    "effect of pointwise activation to the variance of a random variable": "逐点激活对随机变量方差的影响",
    "effect of graph convolution to the variance of a random node signal": "图卷积对随机节点信号方差的影响",
    "lipschitz and integral lipschitz filters": "Lipschitz与积分Lipschitz滤波器",
    "stability bounds for random and basis pes": "随机PEs和基PEs的稳定性界",
    "spectral filters with graph filters": "带图滤波器的谱滤波器",
    "experiments on graph isomorphism": "图同构实验",
    "experiments on peptides-struct dataset": "Peptides-struct数据集实验",
    "ablation on different backbone models": "不同骨干模型的消融",
    "ablation on k": "K的消融",
    "ablation on number of samples m": "样本数M的消融",
    "ablation on the number of gnn layers in pearl": "PEARL中GNN层数的消融",
    "ablation on different parameter size": "不同参数规模的消融",
}
SECTION_HEADINGS_EXTRA = {"baselines": "基线方法", "experiment": "实验", "results and analyses": "结果与分析"}
INLINE_HEADINGS = {"introduction": "引言", "related work": "相关工作", "method": "方法", "methods": "方法", "experiments": "实验", "results": "结果", "discussion": "讨论", "conclusion": "结论", "conclusions": "结论"}
CONTEXT_TRANSLATIONS = {"where": "其中", "satisfies": "满足：", "such that": "使得：", "as follows": "如下："}
PROOF_KINDS = {"proposition": "命题", "theorem": "定理", "lemma": "引理", "corollary": "推论"}
CONFERENCE_TRANSLATION = "发表于ICLR 2025会议论文"
CORRESPONDENCE = r"(?i)\bcorrespond(?:a|e)nce to:\s*\S+"
CORRESPONDENCE_REWRITE = (r"(?i)(\*|∗)?\s*correspond(?:a|e)nce to:\s*([^\s.]+(?:\.[^\s.]+)*\.[A-Za-z]{2,})\.?", "∗通信至：$2。")
SENIOR_REWRITE = (r"(?i)(†)?\s*equal senior authorship\.?", "†共同高级作者。")

# fixed values: cleaning of translated text
NOTE_EN = r"(?i)\s*[\(（][^\)）]*(?:text (?:seems )?(?:continues|is incomplete|appears incomplete)|translation ends|incomplete text)[^\)）]*[\)）]\.?"
NOTE_ZH = r"\s*[\(（][^\)）]*(?:原文未提供|原文未给出|原文不完整|文本不完整|此处应为|未给出完整|缺少上下文)[^\)）]*[\)）]\.?"
LATEX_FONTS, LATEX_TEXT = "mathbb|mathcal|mathrm|mathbf|operatorname", "text|mbox"
LATEX_SYMBOLS = {"Phi": "Φ", "phi": "φ", "sigma": "σ", "lambda": "λ", "Lambda": "Λ", "alpha": "α", "beta": "β", "delta": "δ", "epsilon": "ϵ", "in": "∈", "times": "×", "cdot": "·", "circ": "◦", "leq": "≤", "geq": "≥"}

# fixed values: terms and drifts of translations
NOT_TERMS = ("PDF", "JSON")
ACRONYM, CAPITALISED, PLAIN_WORD = r"(?U)\b[A-Z][A-Z0-9-]{1,}\b", r"(?U)\b[A-Z][A-Za-z0-9-]{2,}\b", r"(?U)\b[A-Za-z][A-Za-z-]{2,}\b"
GRAPH_TOPICS, GRAPH_DRIFT = ("gnn", "gso", "positional encoding", "pearl"), "(?i)全球导航|卫星|强化学习|生成对抗|GAN"
NEURO_TOPICS, NEURO_DRIFT = ("eeg", "brain", "neural"), "材料|冲击|载荷|应力|变形|破坏模式|工程设计"

# fixed values: the offline provider's letters (a to z)
LATIN, OFFLINE = "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这中大来上国个到说们为子和你地出"
