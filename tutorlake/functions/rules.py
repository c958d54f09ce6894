"""The patterns, words and limits that screening and normalising results follow."""

# --- sanitising ---------------------------------------------------------------------------------
MAX_LENGTH, MIN_LENGTH = 2000, 2
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SANITIZE = [(r"\x00", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"[\x00-\x08\x0b-\x1f]", "")]
HTML = [(r"(?is)<script[^>]*>.*?</script>", ""), (r"<[^>]+>", "")]
SCRIPT_URL = [(r"(?i)javascript\s*:", "")]
ROLE_JSON = [(r"""(?i)\{\s*["']role["']\s*:\s*["'](?:system|assistant|user)["']\s*,\s*["']content["']\s*:\s*["'][^"']*["']\s*\}""", "")]
OVERRIDE = [
    (r"(?i)(?:ignore|disregard|forget|override)\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|rules?|context)", ""),
    (r"(?i)you\s+are\s+now\s+(?:a|an|in)\s+(?:different|new)", ""),
    (r"(?i)(?:new|different)\s+(?:system|role)\s*(?:prompt|instruction)", ""),
    (r"(?i)(?:pretend|act)\s+(?:as\s+if|like|that)\s+you", ""),
    (r"(?i)do\s+not\s+follow\s+(?:any|your|the)\s+(?:rules?|instructions?|guidelines?)", ""),
]
SQL = [
    (r"(?i)\bDROP\s+TABLE\b", ""), (r"(?i)\bDELETE\s+FROM\b", ""), (r"(?i)\bINSERT\s+INTO\b", ""), (r"(?i)\bUNION\s+(?:ALL\s+)?SELECT\b", ""),
    (r"(?i)\bSELECT\s+\*\s+FROM\b", ""), (r"(?i)\bUPDATE\s+\w+\s+SET\b", ""), (r"(?i)\bALTER\s+TABLE\b", ""), (r"(?i)\bCREATE\s+TABLE\b", ""),
    (r"(?i)\bEXEC(?:UTE)?\s*\(", ""), (r";\s*--\s", ""), (r"(?i)\bOR\s+1\s*=\s*1\b", ""), (r"""(?i)\bOR\s+['"]?\w+['"]?\s*=\s*['"]?\w+['"]?\s*--""", ""),
]
ENCODED = [(r"(?i)data\s*:\s*\w+/\w+\s*;", ""), (r"(?i)base64\s*,\s*[A-Za-z0-9+/=]{20,}", "")]
#: Marks of which three or more in a row become two.
REPEATED = "!?#@$%^&*<>|~`"
#: Deep sanitising, stage by stage, with the label of what a stage takes out.
STAGES = [
    ("control_characters", [(CONTROL, "")]),
    ("xss_html_tags", HTML),
    ("javascript_protocol", SCRIPT_URL),
    ("json_prompt_injection", ROLE_JSON),
    ("instruction_override", OVERRIDE),
    ("sql_injection", SQL),
    ("encoding_evasion", ENCODED),
]
PRE = [
    (CONTROL, ""), *HTML,
    (r"""(?i)\{["']role["']:\s*["'](?:system|assistant|user)["'],\s*["']content["']:\s*["'][^"']*["']\}""", ""),
    (r"(?i)(?:ignore|disregard|forget)\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions|prompts|rules)", ""),
    (r"(?i)\bDROP\s+TABLE\b", ""), (r"(?i)\bDELETE\s+FROM\b", ""), (r"(?i)\bINSERT\s+INTO\b", ""), (r"(?i)\bUNION\s+SELECT\b", ""),
    (r"(?i)\bSELECT\s+\*\s+FROM\b", ""), (r";\s*--", ""), (r"(?i)\bOR\s+1\s*=\s*1\b", ""), (r"(?i)javascript:", ""),
]

# --- dangerous content, injection ---------------------------------------------------------------
DANGEROUS = [
    (r"\bhow\s+to\s+(make|build|create|construct)\s+(a\s+)?(bomb|explosive|weapon|poison)\b", "weapons"),
    (r"\bhow\s+to\s+(kill|murder|harm|hurt|injure)\s+(someone|a\s+person|people)\b", "violence"),
    (r"\bhow\s+to\s+(hack|crack|breach|break\s+into)\s+(a\s+)?(system|account|computer|network)\b", "hacking"),
    (r"\b(synthesize|manufacture|produce)\s+(illegal\s+)?(drugs?|narcotics?|cocaine|heroin|meth)\b", "drugs"),
]
#: (pattern on lower case, category, severity)
INJECTION = [
    (r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?|context)", "instruction_override", "high"),
    (r"disregard\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?)", "instruction_override", "high"),
    (r"forget\s+(all\s+|everything\s+)?(previous|prior|your)\s+(instructions?|prompts?|rules?|training)", "instruction_override", "high"),
    (r"override\s+(all\s+)?(safety|security|rules?|restrictions?|filters?)", "safety_override", "high"),
    (r"you\s+are\s+now\s+(a|an)\s+(?!calculator|math|tutor|teacher|mentor|assistant\s+for\s+math)", "role_change", "high"),
    (r"pretend\s+(to\s+be|you'?r?e?)\s+(a|an)\s+(?!calculator|math|solving)", "role_change", "high"),
    (r"act\s+as\s+if\s+you\s+(are|were)\s+(?!solving|calculating)", "role_change", "medium"),
    (r"(reveal|show|tell|display|output|print)\s+(me\s+)?(your\s+)?(system\s+)?(prompt|instructions?|rules?|guidelines?)", "prompt_extraction", "high"),
    (r"what\s+(are|is)\s+your\s+(system\s+)?(prompt|instructions?|rules?|programming)", "prompt_extraction", "high"),
    (r"(repeat|recite|echo)\s+(your\s+)?(system\s+)?(prompt|instructions?)", "prompt_extraction", "high"),
    (r"<\s*system\s*>", "tag_injection", "high"),
    (r"```\s*(system|admin|root|inject)", "code_injection", "high"),
    (r"<\s*/?\s*script", "script_injection", "high"),
    (r"(admin|root|sudo|superuser)\s*:\s*", "privilege_escalation", "high"),
    (r"execute\s+(this\s+)?(code|command|script|instruction)", "command_execution", "high"),
    (r"\b(jailbreak|jail\s*break)\b", "jailbreak", "high"),
    (r"bypass\s+(the\s+)?(content\s+)?(filter|safety|security|guard|restriction|moderation)", "bypass_attempt", "high"),
    (r"(escape|break\s+out\s+of)\s+(your\s+)?(constraints?|limitations?|restrictions?|rules?)", "escape_attempt", "high"),
    (r"\bdan\b.*\bdo\s+anything\s+now\b", "dan_prompt", "high"),
    (r"developer\s+mode\s+(enabled?|on|activate)", "developer_mode", "high"),
    (r"""\{\s*"(system|prompt|instruction|role)"\s*:""", "json_injection", "medium"),
]
CONTENT_INJECTION = [
    (r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)", "ignore_instruction"),
    (r"disregard\s+(all\s+)?(previous|prior|above)", "disregard_instruction"),
    (r"forget\s+(all|everything|your|previous)", "forget_instruction"),
    (r"new\s+(instruction|prompt|rule)", "new_instruction"),
    (r"override\s+(your|the|all)", "override"),
    (r"you\s+are\s+now\s+(?!solving|calculating|finding)", "role_change"),
    (r"act\s+as\s+(?!a\s+calculator|a\s+math)", "role_change"),
    (r"pretend\s+(to\s+be|you\s+are)\s+(?!solving)", "pretend"),
    (r"bypass\s+(your|the|all|safety)", "bypass"),
    (r"jailbreak", "jailbreak"),
    (r"<\s*system\s*>", "system_tag"),
    (r"###\s*system", "system_marker"),
]
HARM = [
    (r"\b(make|build|create)\s+(a\s+)?(bomb|explosive|weapon)\b", "weapons"),
    (r"\bhow\s+to\s+(make|build|create)\s+(a\s+)?(gun|weapon|explosive)\b", "weapons"),
    (r"\b(ammunition|firearm|assault\s+rifle)\b", "weapons"),
    (r"\bhow\s+to\s+(kill|murder|harm|hurt|attack)\b", "violence"),
    (r"\b(torture|assassinate|mass\s+shooting)\b", "violence"),
    (r"\bhow\s+to\s+(hack|crack|break\s+into)\b", "illegal"),
    (r"\b(illegal\s+drug|cocaine|heroin|meth)\b", "illegal"),
    (r"\bhow\s+to\s+(steal|rob|fraud)\b", "illegal"),
    (r"\b(porn|pornograph|xxx|nsfw)\b", "adult"),
    (r"\bexplicit\s+sexual\b", "adult"),
]
#: The lookaheads of two of these words decide nothing once the word has to end.
PROFANITY = [r"\bfuck\b", r"\bshit\b", r"\bass\b", r"\bbitch\b", r"\bbastard\b", r"\bdick\b"]
PII = [
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "email"),
    (r"\b\d{10}\b", "phone number"),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "phone number"),
]

# --- how mathematical a text is -----------------------------------------------------------------
QUICK_MATH = [
    r"\d+\s*[+\-*/^=]\s*\d+", r"\b[xyz]\s*[+\-*/^=]", r"[+\-*/^=<>≤≥≠]", r"√|∫|∑|∏|∂|∞|π|θ", r"\b(solve|calculate|find|evaluate|compute|simplify)\b",
    r"\b(equation|derivative|integral|probability|matrix)\b", r"\b(sin|cos|tan|log|ln|sqrt)\b", r"\bhow\s+(many|much|long|far|fast)\b",
]
MATH_WORDS = [
    r"\b(solve|calculate|compute|find|evaluate|simplify|determine)\b", r"\b(prove|show\s+that|verify|check|express)\b", r"\b(differentiate|integrate|derive|factor|expand)\b",
    r"\b(equation|expression|formula|function|inequality)\b", r"\b(polynomial|quadratic|linear|cubic|exponential)\b", r"\b(matrix|matrices|determinant|vector|eigenvalue)\b",
    r"\b(derivative|differential|integral|antiderivative)\b", r"\b(limit|limits|continuity|continuous|discontinuous)\b", r"\b(sequence|series|sum|summation|product)\b",
    r"\b(set|subset|union|intersection|element)\b", r"\b(angle|triangle|circle|rectangle|square|polygon)\b", r"\b(line|curve|slope|tangent|normal|asymptote)\b",
    r"\b(root|zero|solution|answer|result)\b", r"\b(add|subtract|multiply|divide|plus|minus|times)\b", r"\b(sum|difference|product|quotient|remainder)\b",
    r"\b(power|exponent|logarithm|log|ln|sqrt)\b", r"\b(ratio|proportion|percentage|percent|fraction)\b", r"\b(sin|cos|tan|cot|sec|csc|cosec)\b",
    r"\b(sine|cosine|tangent|cotangent|secant|cosecant)\b", r"\b(arcsin|arccos|arctan|inverse\s+trig)\b", r"\b(trigonometry|trigonometric|trig)\b",
    r"\b(algebra|calculus|geometry|arithmetic)\b", r"\b(probability|statistics|combinatorics)\b", r"\b(permutation|combination|factorial|ncr|npr)\b",
    r"\b(mean|median|mode|variance|deviation|average)\b", r"\b(integer|rational|irrational|real|complex|imaginary)\b", r"\b(prime|composite|even|odd|natural|whole)\b",
    r"\b(positive|negative|non-negative|non-positive)\b", r"[+\-*/^=<>≤≥≠±×÷]", r"√|∫|∑|∏|∂|∞|π|θ|α|β|γ|δ|λ|μ|σ", r"\b\d+\s*[+\-*/^]\s*\d+", r"\b[xyz]\s*[+\-*/^=]",
    r"\b[xyz]\s*\^\s*\d", r"\bf\s*\(\s*[xyz]\s*\)", r"\b\d+\s*[xyz]\b", r"\bx\s*=|y\s*=|z\s*=", r"\bhow\s+(many|much|long|far|fast|old)\b",
    r"\bwhat\s+(is|are|was|were)\s+(the\s+)?(value|sum|product|difference|result|answer|total|number)\b", r"\bif\s+.{5,50}(then|find|what|how)\b", r"\bgiven\s+that\b",
    r"\blet\s+[a-z]\s*(=|be)\b", r"\bjee\b|\biit\b|\bjee\s*(main|advanced)\b", r"\bobjective|mcq|multiple\s*choice\b", r"\bprobability\s+of\b",
    r"\bwhat\s+is\s+the\s+probability\b", r"\bhow\s+many\b", r"\bhow\s+much\b", r"\bfind\s+the\s+(probability|value|number|sum|mean)\b", r"\bcalculate\s+the\b",
    r"\b(deck|cards?|dice|coin|balls?|marbles?)\b", r"\b(52|6|2)\s*(cards?|sided|faces?)\b", r"\b(king|queen|jack|ace|hearts?|spades?|diamonds?|clubs?)\b",
    r"\b(heads?|tails?)\b", r"\b(fair|biased|random|chance|odds|likely|likelihood)\b", r"\b(getting|drawing|picking|selecting|choosing)\b",
    r"\b(without replacement|with replacement)\b",
]
WORD_PROBLEM = [
    r"\bhow\s+many\b", r"\bhow\s+much\b", r"\bhow\s+long\b", r"\bhow\s+far\b", r"\bhow\s+fast\b", r"\bfind\s+the\b", r"\bcalculate\s+the\b", r"\bwhat\s+is\s+the\b",
    r"\bdetermine\s+the\b", r"\bif\s+.*(?:then|find|calculate|what)\b", r"\bgiven\s+that\b", r"\bsuppose\b", r"\bassume\b", r"\blet\b.*\b(?:be|=|equal)\b",
    r"\b(?:total|sum|difference|product|ratio)\s+(?:of|is)\b", r"\b\d+\s*(?:times|more|less|than)\b", r"\b(?:increased|decreased)\s+by\b",
    r"\b(?:altogether|remaining|left)\b", r"\b(?:each|every|per)\b.*\b(?:cost|price|rate|speed)\b", r"\b(?:at\s+the\s+rate|per\s+hour|per\s+minute|km/h|m/s)\b",
]
STRUCTURE = [
    r"\b\d+\s*(apples?|oranges?|balls?|books?|pencils?|marbles?|coins?|dollars?|rupees?)\b", r"\b(bought|sold|gave|received|has|have|had|costs?|price)\b.*\d+",
    r"\b\d+\s*(more|less|times|than)\b", r"\b(total|altogether|remaining|left\s+over)\b", r"\b(speed|distance|time|rate|work|age)\b.*\d+",
    r"\b\d+\s*(km|m|cm|kg|g|hours?|minutes?|seconds?|days?|years?)\b", r"\b(twice|thrice|half|quarter|double|triple)\b",
]
OFF_TOPIC = [
    (r"^(who\s+is|who\s+was)\s+[a-z][a-z]+(?!\s+mathematician)", "biography"),
    (r"^tell\s+me\s+(about|a)\s+(story|joke|fact\s+about)", "general_chat"),
    (r"^(write|compose)\s+(a|an|me)\s+(poem|essay|story|song)", "creative_writing"),
    (r"^what('s|\s+is)\s+the\s+(capital|president|king|queen)\s+of", "geography/politics"),
    (r"^(recommend|suggest)\s+(a|me)\s+(movie|book|song|restaurant)", "recommendation"),
    (r"^how\s+do\s+i\s+(cook|make|prepare)\s+", "cooking"),
    (r"^what('s|\s+is)\s+the\s+weather", "weather"),
    (r"^(translate|convert)\s+.+\s+(to|into)\s+(english|french|spanish|hindi)", "translation"),
    (r"^who\s+won\s+(the|last)", "sports/events"),
    (r"^(what|who)\s+(is|are|was|were)\s+.+\s+(religion|political\s+party|president)", "politics/religion"),
]
SMALL_TALK = [
    (r"^what\s+is\s+(your\s+)?(name|favorite|opinion)", "personal"),
    (r"^(hi|hello|hey|good\s+(morning|evening|night))\s*[!.,]?\s*$", "greeting"),
    (r"^(thanks|thank\s+you|thx)\s*[!.,]?\s*$", "thanks"),
    (r"^(bye|goodbye|see\s+you)\s*[!.,]?\s*$", "goodbye"),
]
BOOST_STRONG = [
    r"(?i)[xyz]\s*[\^²³]", r"\d+\s*[+\-*/^]\s*\d+", r"(?i)[xyz]\s*[+\-*/=]\s*\d", r"(?i)\d+\s*[xyz]", r"√|∫|∑|∏|∂|∞|π|θ", r"(?i)\bsin\b|\bcos\b|\btan\b", r"(?i)\bd/dx\b|\bdy/dx\b", r"=\s*0\b",
]
BOOST_WORDS = [
    r"\bhow\s+(many|much)\b", r"\bfind\s+the\b", r"\bcalculate\b", r"\bsolve\b", r"\bwhat\s+is\s+the\s+(probability|value|area|sum)\b", r"\bprobability\s+of\b",
]

# --- output -------------------------------------------------------------------------------------
INAPPROPRIATE = ["kill", "murder", "weapon", "bomb", "drug", "porn", "nude", "violence", "hate"]

# --- normalising --------------------------------------------------------------------------------
SPOKEN = [
    (r"\bsquare root of\b", "√"), (r"\bcube root of\b", "∛"), (r"\braised to the power of?\b", "^"), (r"\bto the power of?\b", "^"), (r"\bsquared\b", "^2"), (r"\bcubed\b", "^3"),
    (r"\bdivided by\b", "/"), (r"\bmultiplied by\b", "*"), (r"\btimes\b", "*"), (r"\bplus\b", "+"), (r"\bminus\b", "-"), (r"\bequals?\b", "="),
    (r"\balpha\b", "α"), (r"\bbeta\b", "β"), (r"\bgamma\b", "γ"), (r"\bdelta\b", "δ"), (r"\btheta\b", "θ"), (r"\blambda\b", "λ"), (r"\bsigma\b", "σ"), (r"\bpi\b", "π"),
    (r"\bintegral of\b", "∫"), (r"\bderivative of\b", "d/dx"), (r"\blimit as\b", "lim"), (r"\binfinity\b", "∞"),
    (r"\bx squared\b", "x^2"), (r"\by squared\b", "y^2"), (r"\bsummation\b", "Σ"), (r"\bfor all\b", "∀"), (r"\bthere exists\b", "∃"),
]
TOKEN_SIGNS = [
    (r"x\^2|x²", "x squared"), (r"x\^3|x³", "x cubed"), (r"\^2", " squared"), (r"\^3", " cubed"), (r"√", "sqrt square root"), (r"∫", "integral"), (r"∑", "sum summation"), (r"π", "pi"),
    (r"d/dx", "derivative ddx"), (r"dy/dx", "derivative dydx"),
]
SIMPLE = [r"^\s*[\d\.\s\+\-\*/\(\)\^]+\s*$", r"^what\s+is\s+\d+\s*[\+\-\*/]\s*\d+", r"^\d+\s*!$", r"^(?:find\s+)?\d+[cp]\d+$"]
COMPLEX = [
    "prove", "proof", "show that", "by induction", "differential equation", "multiple integrals", "double integral", "triple integral", "eigenvalue", "eigenvector", "diagonalize",
    "taylor series", "maclaurin", "fourier", "jee advanced", "olympiad", "if and only if", "necessary and sufficient",
]
CITED = [
    r"(?i)according to (the )?(textbook|book|source|reference)", r"(?i)as stated in", r"(?i)in the (textbook|book|manual|guide)", r"(?i)page \d+", r"(?i)chapter \d+",
    r"(?i)from (the )?(internet|web|online)", r"(?i)https?://\S+",
]
COMPONENTS = ["step", "answer", "result", "solution", "therefore", "thus", "hence", "="]
REFUSAL = [
    r"(?i)i (cannot|can't|won't|will not) (help|assist) with", r"(?i)i (don't|do not) have (access|information)", r"(?i)as an ai", r"(?i)i('m| am) (just )?(a|an) (language model|ai|assistant)",
]

# --- expansion of questions ---------------------------------------------------------------------
#: (topic, keywords, terms), in order.
EXPANSIONS = [
    ("probability", ["probability", "chance", "odds", "likelihood", "P("], ["favorable outcomes", "total outcomes", "sample space", "event", "random experiment"]),
    ("cards", ["card", "cards", "deck", "king", "queen", "jack", "ace", "hearts", "spades", "diamonds", "clubs"], ["52 cards", "standard deck", "playing cards", "suits", "face cards", "probability cards"]),
    ("coins", ["coin", "heads", "tails", "toss", "flip"], ["coin toss", "fair coin", "probability heads tails", "binomial", "bernoulli trial"]),
    ("dice", ["dice", "die", "roll", "rolling"], ["six-sided", "fair dice", "probability rolling", "outcomes dice"]),
    ("derivative", ["derivative", "differentiate", "differentiation", "d/dx", "dy/dx"], ["rate of change", "slope", "tangent", "differential", "chain rule", "product rule", "quotient rule"]),
    ("integral", ["integral", "integrate", "integration", "antiderivative"], ["area under curve", "indefinite integral", "definite integral", "integration techniques", "substitution", "by parts"]),
    ("limit", ["limit", "lim", "approaches", "tends to"], ["limit definition", "continuity", "L'Hopital", "squeeze theorem", "limit laws"]),
    ("quadratic", ["quadratic", "x^2", "x²", "parabola"], ["quadratic formula", "roots", "discriminant", "factoring", "completing square", "ax² + bx + c"]),
    ("equation", ["equation", "solve", "solution", "root", "zero"], ["find x", "solving equations", "algebraic equation"]),
    ("polynomial", ["polynomial", "degree", "coefficient"], ["factor theorem", "remainder theorem", "roots polynomial"]),
    ("trigonometry", ["sin", "cos", "tan", "sine", "cosine", "tangent", "trig", "trigonometric"], ["trigonometric functions", "trig identities", "unit circle", "radians degrees"]),
    ("mean", ["mean", "average", "arithmetic mean"], ["central tendency", "sum divided by n", "expected value"]),
    ("standard_deviation", ["standard deviation", "std", "σ", "variance"], ["dispersion", "spread", "deviation from mean", "variance square root"]),
    ("matrix", ["matrix", "matrices", "determinant"], ["matrix operations", "inverse matrix", "transpose", "eigenvalue", "eigenvector"]),
    ("area", ["area", "surface area"], ["formula area", "square units", "calculate area"]),
    ("circle", ["circle", "radius", "diameter", "circumference"], ["pi r squared", "πr²", "2πr", "area circle"]),
]
