"""Patterns, tables, formats and limits that results depend on.

They are part of the data contract and have to stay exactly as they are.
"""

# --- patterns -----------------------------------------------------------------
CVE_ID = r"CVE-\d{4}-\d{4,}"
COMMIT_HASH = r"\b[a-fA-F0-9]{40}\b"
GITHUB_REPO = r"https?://github\.com/([^/]+)/([^/]+)"
CLONE_PATH = r"github\.com[:/](.+?)/commit"
ISSUE_NUMBER = r"#(\d+)"
JSON_OBJECT = r"(?s)(\{.*\})"
FILE_PATHS = r"diff --git a/(.+?) b/(.+)"
FILE_A_PATH = r"diff --git a/(.*?) b/"
HUNK_HEADER = r"^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@.*$"
PATCH_COMMAND = r"\ndiff --git [^@]+"
PATCH_COMMAND_PATHS = r'(?d)\ndiff --git (?:"|)a/(.+)\s(?:"|)b/(.+)\n'
OLD_RANGE_WORD = r"(?<!\S)-(\d+),\d+[^\s,]*(?!\S)"

# --- tables -------------------------------------------------------------------
COMMENT_STARTS = ["//", "/**", "/*", "*", "*/", "#"]
EXTENSION_LANGUAGE = {
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cxx": "cpp",
    "cc": "cpp",
    "hpp": "cpp",
    "py": "python",
    "php": "php",
    "java": "java",
    "go": "go",
}
TRUE_WORDS = ["true", "1", "yes"]
GLOB_CHARS = ["*", "?", "[", "]"]
RANK_KS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 30, 50, 100]
GRID_LAMBDAS = [round(0.1 + 0.5 * i, 1) for i in range(20)]
MARKUP_ESCAPES = ["_", "%", "&", "$"]
WEAKNESS_VIEWS = {
    "conceptual": ["Description", "Extended Description", "Common Consequences", "Relationships",
                   "Content History"],
    "operational": ["Description", "Extended Description", "Common Consequences",
                    "Potential Mitigations", "Detection Methods", "Observed Examples",
                    "Content History"],
    "mapping friendly": ["Description", "Extended Description", "Relationships", "References",
                         "Content History"],
}

# --- texts --------------------------------------------------------------------
ROOT_COMMIT = "Commit %s is the root commit. No diff available."
PATCH_ERRORS = {
    "empty": "PatchMinErrorType.EMPTY_CHANGE",
    "odd": "PatchMinErrorType.ODD_FILE",
    "fail": "PatchMinErrorType.FAIL",
}
NO_JSON = "No JSON object found in string"
BAD_JSON = "JSONDecodeError"
BAD_ANSWER = "Answer must be either True or False"
BAD_CONFIDENCE = "Confidence must be an integer between 1 and 5"
BAD_EXPLANATION = "Explanation must be a non-empty string"
SEARCH_TOO_MANY = "Too many results found. Please be more specific."
GREP_TOO_MANY = "Too many files found. Please be more specific."
SEARCH_NONE = "No matches found for '%s'."
FILES_TOO_MANY = "Too many files found (more than 50). Please refine your search query."
FILES_NONE = "No files found matching '%s'."
PAGE_HEADER = "Viewing lines %s to %s of %s:"
PAGE_INVALID = "Invalid line number. Must be between 1 and %s."
ADVISORY_MISSING = "CVE not yet in NVD - No details available"
WEAKNESS_MISSING = "CWE not found - No details available"

# --- limits -------------------------------------------------------------------
PAGE_SIZE = 100
TOKENS_PER_CHAR = 0.3
REPO_SIZE_LIMIT = 1024 ** 3
SHARD_BYTES = 250 * 1000 * 1000
REPORT_TTL_SECONDS = 3600
HUNK_CONTEXT = 3

# --- report formats -----------------------------------------------------------
SCORE_LINKS = {
    "v31": ("https://www.first.org/cvss/calculator/3.1#", ""),
    "v30": ("https://www.first.org/cvss/calculator/3.0#", ""),
    "v2": ("https://nvd.nist.gov/vuln-metrics/cvss/v2-calculator?vector=(", ")"),
}
SCORE_FORMAT = (
    "#### CVSS {{version}} Score - {{type}} - {{source}}\n\n"
    "Base Severity: {{severity}} - {{score}} (Exploitability: {{exploitability}}, Impact: {{impact}})\n"
    "Vector: [{{vector}}]({{link}})\n"
)
WEAKNESS_HEAD = "| Weakness | Type | Source |\n| --- | --- | --- |"
WEAKNESS_FORMAT = "\n| [[{{value}}]] | {{type}} | {{source}} |"
REFERENCE_HEAD = "| URL | Tags | Source |\n| --- | --- | --- |"
REFERENCE_FORMAT = "\n| [{{url}}]({{url}}) | {{tags}} | {{source}} |"
EXPLOITED_FORMAT = (
    '<font color="red">KNOWN EXPLOITED VULNERABILITY</font>\n'
    "CISA Details: {{name}}, Added: [[{{added}}]], Action: {{action}}, Due: [[{{due}}]]"
)
NOT_EXPLOITED_FORMAT = (
    "As of {{today}}, this issue is not currently on the CISA Known Exploited Vulnerabilities List"
)
CONFIGURATION_FORMAT = "#### Configuration {{number}} (Operator: {{operator}}, Negate: {{negate}})\n\n{{nodes}}"
NODE_FORMAT = "##### Node {{number}}\n\n{{products}}\n"
PRODUCT_FORMAT = "- {{criteria}}\n"
VERSION_FORMATS = {
    "versionStartIncluding": "  - Start Version:  {{v}} (Including)\n",
    "versionStartExcluding": "  - Start Version: {{v}} (Excluding)\n",
    "versionEndIncluding": "  - End Version: {{v}} (Including)\n",
    "versionEndExcluding": "  - End Version: {{v}} (Excluding)\n",
}
COMMENT_FORMAT = "{{number}}. {{comment}} (by {{organization}}, last modified: {{modified}})\n"
EVALUATOR_FORMATS = {
    "evaluatorComment": "#### Evaluator Comment\n\n{{text}}\n\n",
    "evaluatorSolution": "#### Evaluator Solution\n\n{{text}}\n\n",
    "evaluatorImpact": "#### Evaluator Impact\n\n{{text}}\n\n",
}
ADVISORY_DEFAULTS = {
    "scores": "No scores defined",
    "weaknesses": "No weaknesses defined",
    "references": "No references defined",
    "configurations": "No configurations defined",
    "comments": "No vendor comments\n",
    "evaluator": "None provided",
}
ADVISORY_FORMAT = """
## CVE Details

ID: {{id}}
{{exploited}}
Source Identifier: {{source}}
Published: {{published}}
Last Modified: {{modified}}
Status: {{status}}

### Scores

{{scores}}

### Description

{{description}}

### Evaluator Notes

{{evaluator}}

### Weaknesses

{{weaknesses}}

### Vendor Comments

{{comments}}
### References

{{references}}

### Configurations

{{configurations}}
"""
WEAKNESS_REPORT_FORMAT = """
## CVE Details
{{id}}: {{name}}
Weakness ID: {{id}}
Vulnerability Mappping: Usage: {{usage}}, Rationale: {{rationale}}
Abstraction: {{abstraction}}

{{sections}}"""
WEAKNESS_SECTIONS = {
    "Description": "### Description\n{{text}}\n\n",
    "Extended Description": "### Extended Description\n{{text}}\n\n",
    "Common Consequences": "### Common Consequences\n{{text}}\n",
    "Potential Mitigations": "### Potential Mitigations\n{{text}}\n",
    "Relationships": "### Relationships\n{{text}}\n",
    "Observed Examples": "### Observed Examples\n{{text}}\n",
    "Detection Methods": "### Detection Methods\n{{text}}\n",
    "References": "### References\n{{text}}\n",
    "Content History": "### Content History\n{{text}}\n",
}
WEAKNESS_ITEMS = {
    "Common Consequences": "* Scope: {{scope}}\n  * Impact: {{impact}}\n",
    "Potential Mitigations": "* {{id}}: {{text}}\n",
    "Relationships": "* {{nature}}: CWE-{{id}}\n",
    "Observed Examples": "* {{reference}}: {{text}} ({{link}})\n",
    "Detection Methods": "* {{method}}: {{text}}\n",
    "References": "* {{title}}: {{url}}\n",
    "Content History": "* {{type}}: {{name}} ({{date}})\n",
}
