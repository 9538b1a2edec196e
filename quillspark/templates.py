"""Generation tables (our own wording). Operators read these as data; the
oracle SQL is generated from the same tables.

Placeholders: {verb} {noun} {obj} {ctx} {Action} {subject} {output}
{project} {team} {stakeholder} {industry} {deadline}.
"""

from __future__ import annotations

# FIXED VALUES: slot layout of the 10-prompt family (variant, complexity per slot)
SLOT_LAYOUT = [
    ("direct_request", "simple"), ("direct_request", "simple"),
    ("contextual", "medium"), ("contextual", "medium"),
    ("conditional", "medium"), ("multi_step", "complex"),
    ("analytical", "complex"), ("comparative", "complex"),
    ("hypothetical", "expert"), ("creative", "expert"),
]
PLACEHOLDER_VALUES = ["?", "-", "N/A", "null", "undefined"]
CANDIDATE_OFFSETS = [0, 10, 11, 12]  # var = slot + offset for the dedup alternates

VERBS = {  # action -> (base form, noun phrase)
    "SUMMARIZE": ("summarize", "a summary of"), "CREATE": ("create", "a new version of"),
    "FIND": ("find", "a search for"), "EXPLAIN": ("explain", "an explanation of"),
    "COMPARE": ("compare", "a comparison of"), "PLAN": ("plan", "a plan for"),
    "SCHEDULE": ("schedule", "a schedule for"), "LIST": ("list", "a list of"),
    "DRAFT": ("draft", "a draft of"), "REVIEW": ("review", "a review of"),
    "ANALYZE": ("analyze", "an analysis of"), "GET": ("get", "a copy of"),
}

OBJECT_PHRASES = {
    "EMAIL": ["my latest email", "the email thread", "this email", "the unread emails"],
    "MEETING": ["my next meeting", "the project meeting", "our weekly meeting"],
    "DOCUMENT": ["this document", "the shared document", "my draft document", "the document"],
    "DATA": ["the sales data", "this dataset", "the latest numbers"],
}

WORK_CONTEXTS = ["the weekly sync", "a client review", "the quarterly plan", "the team standup",
                 "a leadership brief"]
TIME_CONTEXTS = ["from last week", "from this month", "from the last sprint", "from yesterday",
                 "since the last release"]
CONDITIONS = ["if anything changed", "only where it matters", "but only recent items",
              "if there is enough detail"]
SECOND_STEPS = ["then list the open questions", "then draft next steps", "then flag the risks"]
ANGLES = ["the main trends", "what stands out", "the gaps", "the likely causes"]
COMPARISONS = ["last quarter", "the previous version", "our targets"]
SCENARIOS = ["the budget is cut in half", "the deadline moves up a week", "a new client joins"]
CREATIVE = ["a short story", "a catchy headline", "a one-line pitch"]

# per slot: (templates, object shift, context list name, subject clause, output clause)
V2_SLOTS = [
    (["{Action} {obj}, if you would.", "Time to {verb} {obj}, so go ahead.",
      "The task today: {verb} {obj}.", "Somebody has to {verb} {obj}; take it on."], 0, None,
     " The topic is {subject}.", " Wanted: {output}."),
    (["Take {obj} and {verb} it.", "Our goal is to {verb} {obj}.", "Let us {verb} {obj} together.",
      "Next on the list: {verb} {obj}."], 1, None, " Topic: {subject}.", " Hand over {output}."),
    (["With {ctx} in view, {verb} {obj}.", "People at {ctx} expect {obj}: {verb} it.",
      "{Action} {obj} so that {ctx} runs smoothly."], 0, "WORK_CONTEXTS", " Stress {subject}.",
     " Shape: {output}."),
    (["{Action} {obj} {ctx}, nothing older.", "What changed {ctx}? {Action} {obj}.",
      "Go through {obj} {ctx} and {verb} what counts."], 2, "TIME_CONTEXTS",
     " Leave out all but {subject}.", " Put it into {output}."),
    (["{Action} {obj} {ctx}.", "Could you {verb} {obj}, {ctx}?"], 0, "CONDITIONS",
     " Limit it to {subject}.", " Give it as {output}."),
    (["First {verb} {obj}, {ctx}.", "Start by asking me to {verb} {obj}, {ctx}."], 1, "SECOND_STEPS",
     " Cover {subject}.", " Put the result in {output}."),
    (["{verb} {obj} and tell me {ctx}.", "Look at {obj}: {verb} it and point out {ctx}."], 2,
     "ANGLES", " Pay attention to {subject}.", " Summarize findings as {output}."),
    (["{verb} {obj} against {ctx}.", "How does {obj} compare with {ctx}? {Action} it."], 0,
     "COMPARISONS", " Stay on {subject}.", " Lay it out as {output}."),
    (["Suppose {ctx}: how would you {verb} {obj}?", "If {ctx}, {verb} {obj} accordingly."], 1,
     "SCENARIOS", " Keep {subject} in mind.", " Answer as {output}."),
    (["{verb} {obj} and turn it into {ctx}.", "Use {obj} to write {ctx}."], 3, "CREATIVE",
     " Draw on {subject}.", " Deliver it as {output}."),
]

# v1: random template pick (seeded), three subject-aware lists
V1_TEMPLATES = {
    "direct_request": ["Next on my list: {verb} {obj}.", "{Action} {obj}, nothing else.", "One job for you, {verb} {obj}.",
                       "Today I want {noun} {obj}.", "{Action} all of {obj}."],
    "contextual": ["We are in the middle of {ctx}: {verb} {obj}.", "{ctx} is coming up, so {verb} {obj}.",
                   "{Action} {obj}; it feeds into {ctx}.", "Nobody prepared {obj} for {ctx} yet, {verb} it.",
                   "{Action} {obj} in the light of {ctx}."],
    "conditional": ["{Action} {obj} once the numbers are final.", "No change since Monday? Then skip it, else {verb} {obj}.",
                    "{Action} {obj} provided that it is complete.", "Where {obj} has gaps, name them, then {verb} it.",
                    "{Action} {obj} as long as it stays under a page."],
    "multi_step": ["{Action} {obj}, then list who must act.", "Sort {obj} by date, {verb} it, and draft a reply.",
                   "Three steps: open {obj}, {verb} it, check the totals.", "{Action} {obj}; afterwards write two questions about it.",
                   "Clean up {obj} first and {verb} it after that."],
    "analytical": ["{Action} {obj} and weigh the causes.", "Which pattern runs through {obj}? {Action} it.",
                   "{Action} {obj}, worst problem on top.", "Test the claims in {obj} and {verb} what holds.",
                   "{Action} {obj}; show how you got there."],
    "comparative": ["{Action} {obj} beside last quarter's.", "Put two versions of {obj} next to each other and {verb} both.",
                    "{Action} {obj} and mark every difference to the plan.", "Old or new {obj}: {verb} the stronger one.",
                    "{Action} {obj} in a table of pros and cons."],
    "hypothetical": ["Half the team is away: {verb} {obj} anyway.", "Say the launch slips a month; {verb} {obj} for that case.",
                     "You join us tomorrow. {Action} {obj} to get started.", "With twice the money, how would you {verb} {obj}?",
                     "No network for a day: {verb} {obj} from memory."],
    "creative": ["{Action} {obj} as a headline.", "Tell {obj} to a ten-year-old: {verb} it.", "{Action} {obj} in five emoji and a line.",
                 "A poster about {obj}: {verb} it.", "{Action} {obj} like a weather report."],
}
V1_SUBJECT_TEMPLATES = {
    "direct_request": ["{Action} the part of {obj} that deals with {subject}.", "{subject} only: {verb} {obj}.",
                       "Within {obj}, find {subject} and {verb} it."],
    "contextual": ["{ctx} will turn on {subject}; {verb} {obj}.", "{Action} {obj}, seen from {subject}, ahead of {ctx}.",
                   "They will ask about {subject} at {ctx}. {Action} {obj}."],
    "analytical": ["{Action} {obj}: how much of it is due to {subject}?",
                   "Trace {subject} through {obj} and {verb} it.", "{Action} {obj} and back each point on {subject}."],
}
V1_OUTPUT_SUFFIXES = [" Return {output}.", " Format as {output}.", " Use {output} for the answer."]

# v3 scenarios: (name, with-context template, without-context template)
V3_SCENARIOS = [
    ("executive_briefing", "Using the notes below, {verb} {obj} for {stakeholder} at {project}.",
     "{Action} {obj} for {stakeholder} at {project}."),
    ("client_meeting_prep", "Based on this material, {verb} {obj} before meeting {stakeholder}.",
     "Before meeting {stakeholder}, {verb} {obj}."),
    ("team_collaboration", "Read the thread below and {verb} {obj} for {team}.",
     "{Action} {obj} so {team} can pick it up."),
    ("quarterly_review", "From the report below, {verb} {obj} for the quarterly review.",
     "{Action} {obj} for the quarterly review of {project}."),
    ("project_milestone", "Given the update below, {verb} {obj} for the {project} milestone.",
     "{Action} {obj} for the {project} milestone by {deadline}."),
    ("compliance_audit", "Check the text below against {regulation} and {verb} {obj}.",
     "{Action} {obj} with {regulation} in mind."),
    ("training_development", "Turn the material below into training: {verb} {obj} for {team}.",
     "{Action} {obj} as training material for {team}."),
    ("vendor_evaluation", "Using the details below, {verb} {obj} for a vendor in {industry}.",
     "{Action} {obj} to compare vendors in {industry}."),
    ("budget_planning", "With the figures below, {verb} {obj} for the {project} budget.",
     "{Action} {obj} for next year's {project} budget."),
    ("strategic_initiative", "From the brief below, {verb} {obj} for the {industry} strategy.",
     "{Action} {obj} for our {industry} strategy by {deadline}."),
]
# what a scenario's answer is judged by, and the dimension that it adds (ours)
V3_SCENARIO_RUBRIC = {
    "executive_briefing": (["Fits on one page", "The ask is explicit"], "brevity"),
    "client_meeting_prep": (["Lists three likely questions", "Nothing internal is disclosed"], "tact"),
    "team_collaboration": (["Says who does what next", "Open points are separate"], "actionability"),
    "quarterly_review": (["Figures name their quarter", "Misses are not hidden"], "candour"),
    "project_milestone": (["Done and not done are told apart", "The next date is given"], "timeliness"),
    "compliance_audit": (["Every finding cites its rule", "Severity is graded"], "traceability"),
    "training_development": (["Starts with what learners know", "Ends with an exercise"], "teachability"),
    "vendor_evaluation": (["All vendors face the same list", "Costs cover the whole term"], "fairness"),
    "budget_planning": (["Totals add up", "Assumptions carry a number"], "arithmetic"),
    "strategic_initiative": (["Says what will not be done", "Names a measure of success"], "foresight"),
}
WITH_CONTEXT_LINE = "Every claim can be found in the document given"
WITHOUT_CONTEXT_LINE = "Missing facts are asked for, not invented"
V3_VALUES = {
    "project": ["Atlas", "Beacon", "Cobalt", "Delta", "Ember", "Falcon"],
    "team": ["the data team", "the sales team", "the platform group", "the design crew"],
    "stakeholder": ["the CFO", "our sponsor", "the client lead", "the board"],
    "industry": ["retail", "healthcare", "banking", "logistics", "energy"],
    "regulation": ["GDPR", "SOX", "HIPAA", "ISO 27001"],
    "deadline": ["Friday", "month end", "the next sprint", "Q3"],
}
# FIXED VALUES: context document kinds (v3 rule): ordered tests on the object words, then on the slot
V3_CONTEXT_RULES = [
    ("meeting_notes", ["MEETING", "NOTES"], 3),
    ("email_thread", ["EMAIL", "MESSAGE"], 5),
    ("project_report", ["REPORT", "STATUS"], 7),
    ("policy_document", ["POLICY", "DOCUMENT"], None),
]
V3_CONTEXT_DEFAULT = "technical_document"
CONTEXT_BODIES = {
    "meeting_notes": "{project}, Tuesday, 40 minutes. In the room: {team}. Agenda point two, {obj}: {Action} it before we vote.",
    "email_thread": "> {team} wrote: the numbers on {obj} moved again. > Reply: then {project} needs a new version by {deadline}.",
    "project_report": "{project} in week nine. Done: six of eight parts. Late: the supplier. {deadline}: next gate.",
    "policy_document": "Rule 4 on {obj}. Who may sign: {team}. What must be kept: two years of records. Exceptions go to the owner.",
    "technical_document": "How {obj} works inside {project}: one table in, one table out, nightly, at most 2 GB.",
}
# FIXED VALUES: actions that need a context document
ACTIONS_NEEDING_CONTEXT = ["SUMMARIZE", "EXPLAIN", "REVIEW", "ANALYZE", "ASSESS", "EVALUATE",
                           "PROOFREAD", "EDIT", "TRANSLATE", "REWRITE"]

# offline templates: (variant, template, needs) with needs in {None, 'subject', 'nosubject', 'output'}
OFFLINE = [
    ("direct_request", "{Action} {obj}, limited to {subject}.", "subject"),
    ("direct_request", "The subject is {subject}; {verb} whatever {obj} says on it.", "subject"),
    ("direct_request", "{Action} {obj}, all of it.", "nosubject"),
    ("contextual", "An audit starts soon; {verb} {obj} with that in mind.", None),
    ("conditional", "Should {obj} be empty, say so; otherwise {verb} it.", None),
    ("analytical", "{Action} {obj}, naming the evidence behind every claim.", None),
    ("multi_step", "Gather what concerns {obj}, {verb} it, and check the outcome twice.", None),
    ("output_specific", "The deliverable is {output}: {verb} {obj} to get there.", "output"),
]

# FIXED VALUES: the action groups; the lines are ours
RUBRIC_GROUPS = [
    ("generative", ["CREATE", "WRITE", "GENERATE", "DRAFT"],
     ["The {obj} could be handed over without edits", "Sections come in the order a reader expects"]),
    ("retrieval", ["FIND", "GET", "LOCATE", "SEARCH"],
     ["Each hit names its origin", "Nothing outside the asked scope is returned",
      "Missing {obj} are reported as missing"]),
    ("synthesis", ["SUMMARIZE", "RECAP"],
     ["Far shorter than its source", "No statement that the source lacks"]),
    ("explanation", ["EXPLAIN", "DEFINE", "DESCRIBE"],
     ["Starts from what a newcomer knows", "Contains a worked example"]),
    ("enumeration", ["LIST", "ENUMERATE"],
     ["One entry per line", "No entry occurs twice", "States how many {obj} there are"]),
    ("recommendation", ["SUGGEST", "RECOMMEND", "PROPOSE"],
     ["Ranks the proposals", "Names the cost of every proposal"]),
    ("analysis", ["ANALYZE", "EVALUATE", "ASSESS", "REVIEW"],
     ["States the question before the answer", "Separates measurement from opinion",
      "Says what would change the verdict"]),
    ("comparison", ["COMPARE", "CONTRAST"],
     ["Uses one yardstick for all sides", "Ends in a table or a ranking"]),
]
RUBRIC_DEFAULT = ["Carries the {action} request to its end", "Reads without spelling slips"]
RUBRIC_OUTPUT = "The answer arrives as {output}"
RUBRIC_VARIANT = {
    "multi_step": "Intermediate results are shown",
    "analytical": "Numbers carry their units",
    "comparative": "Names a winner or a tie",
    "hypothetical": "Assumptions are spelled out",
    "creative": "Avoids stock phrases",
}
# FIXED VALUES: dimensions and the actions that add one
BASE_DIMENSIONS = ["accuracy", "completeness", "relevance", "clarity", "helpfulness"]
CREATIVITY_ACTIONS = ["CREATE", "WRITE", "SUGGEST", "DRAFT"]
ACTIONABILITY_ACTIONS = ["SUGGEST", "RECOMMEND", "ANALYZE"]
# criteria by action type (declared table, ours), default row
ACTION_TYPE_CRITERIA = {
    "SUMMARIZE": "coverage", "CREATE": "originality", "FIND": "recall", "EXPLAIN": "clarity",
    "COMPARE": "balance", "PLAN": "feasibility", "SCHEDULE": "fit", "LIST": "completeness",
    "ANALYZE": "insight",
}
ACTION_TYPE_DEFAULT = "helpfulness"
# what to look for by action type, as lists (ours), default row
ACTION_TYPE_LISTS = {
    "SUMMARIZE": ["The main decision is in the first line", "Names and numbers match the source"],
    "CREATE": ["Could be sent without edits", "Fits the audience named", "Nothing is left as a placeholder"],
    "FIND": ["Every hit can be opened", "The newest hit comes first"],
    "EXPLAIN": ["No term goes undefined", "One example from daily work"],
    "COMPARE": ["Each side gets the same questions", "Differences come before likenesses"],
    "PLAN": ["Every step has an owner and a date", "What may slip is marked"],
    "SCHEDULE": ["No two entries overlap", "Time zones are given"],
    "LIST": ["Sorted by a stated rule", "The count is right"],
    "ANALYZE": ["Cause and effect are told apart", "The size of each effect is given"],
}
ACTION_TYPE_LIST_DEFAULT = ["Does what was asked, no more", "Says what is uncertain"]
# extra criteria by capability: the flags are fixed values, the criteria ours
CAPABILITY_CRITERIA = [
    ("coding", "requires_code_execution", ["Runs as given", "Handles empty input", "Names tell their purpose"]),
    ("creative_writing", "requires_creativity", ["Surprising turns", "One consistent voice"]),
    ("image_creation", "requires_image_creation", ["Every requested element is visible", "No garbled lettering"]),
    ("web_search", "requires_web_search", ["Links resolve", "Dates are given", "Answers the query asked"]),
    ("analysis", "requires_reasoning", ["Each step follows from the last", "Limits are admitted"]),
]

# FIXED VALUES: complexity word ranges and the requested mix per intent
COMPLEXITY_WORDS = {"simple": (5, 20), "medium": (15, 40), "complex": (30, 60), "expert": (40, 80)}
MIX_GROUPS = {"direct_request": "direct", "contextual": "contextual", "conditional": "conditional_multi",
              "multi_step": "conditional_multi", "analytical": "analytical_comparative",
              "comparative": "analytical_comparative", "creative": "creative_hypothetical",
              "hypothetical": "creative_hypothetical"}
MIX_QUOTA = {"direct": 2, "contextual": 2, "conditional_multi": 2, "analytical_comparative": 2,
             "creative_hypothetical": 2}
LEVEL_QUOTA = {"simple": 2, "medium": 3, "complex": 3, "expert": 2}

# FIXED VALUES: action and object categories (exact upper-case match, first wins)
ACTION_CATEGORIES = [
    ("generative", ["CREATE", "WRITE", "GENERATE", "COMPOSE", "DRAFT"]),
    ("retrieval", ["FIND", "GET", "SEARCH", "LOCATE", "RETRIEVE"]),
    ("synthesis", ["SUMMARIZE", "RECAP", "CONDENSE", "DIGEST"]),
    ("explanation", ["EXPLAIN", "DEFINE", "CLARIFY", "DESCRIBE"]),
    ("enumeration", ["LIST", "ENUMERATE", "CATALOG", "ITEMIZE"]),
    ("recommendation", ["SUGGEST", "RECOMMEND", "PROPOSE", "ADVISE"]),
    ("transformation", ["MODIFY", "CONVERT", "TRANSFORM", "CHANGE", "REPLACE"]),
    ("analysis", ["ANALYZE", "EVALUATE", "ASSESS", "REVIEW"]),
    ("verification", ["CHECK", "VERIFY", "VALIDATE", "CONFIRM", "DETERMINE"]),
    ("organization", ["ORGANIZE", "ARRANGE", "SORT", "STRUCTURE"]),
    ("communication", ["SEND", "SHARE", "CONTACT", "NOTIFY"]),
    ("enhancement", ["ENHANCE", "IMPROVE", "OPTIMIZE", "FIX"]),
    ("inclusion", ["ADD", "INCLUDE", "ATTACH", "INSERT"]),
    ("extraction", ["EXTRACT", "HIGHLIGHT", "IDENTIFY", "COUNT"]),
    ("comparison", ["COMPARE", "CONTRAST", "DIFFERENTIATE"]),
    ("preparation", ["PREPARE", "SET UP", "CONFIGURE", "SCHEDULE"]),
]
OBJECT_CATEGORIES = [
    ("documents", ["DOCUMENT", "FILE", "ARTICLE", "PROPOSAL", "REPORT"]),
    ("communication", ["EMAIL", "MESSAGE", "MESSAGES", "CHANNEL MESSAGES"]),
    ("content", ["TEXT", "CODE", "SCRIPT", "CONTENT", "STATEMENT"]),
    ("data", ["DATA", "TABLE", "LIST", "FORMULA", "GRAPH"]),
    ("media", ["IMAGE", "PICTURE", "PHOTO", "DIAGRAM"]),
    ("presentations", ["PRESENTATION", "SLIDE", "DECK"]),
    ("meetings", ["MEETING", "MEETING TIMES", "AGENDA", "ACTION ITEMS"]),
    ("organizational", ["PEOPLE", "TEAMS", "COMPANIES", "ROLES", "CONTACTS"]),
    ("tasks", ["TASKS", "PROJECTS", "TIMELINE", "PLAN"]),
    ("information", ["INFORMATION", "UPDATES", "NEWS", "SUMMARY", "KEY TAKEAWAYS"]),
    ("resources", ["URL", "LINK", "TEMPLATE", "RESOURCES", "EXAMPLES"]),
    ("ideas", ["IDEAS", "SUGGESTIONS", "TIPS", "BEST PRACTICES", "INSIGHTS"]),
]
TRANSFORM_ACTIONS = ["CONVERT", "TRANSFORM", "MODIFY"]

# generation flags -> instruction line: the names are fixed values, the lines ours
GENERATION_FLAGS = [
    ("must_include_action_verb", "- One imperative per request, taken from the action"),
    ("preserve_intent_semantics", "- Action and object may not change"),
    ("natural_language_style", "- Write as in a chat with a colleague"),
    ("avoid_ambiguity", "- A reader must see exactly one task"),
    ("enterprise_context", "- Office settings only"),
    ("professional_tone", "- No slang"),
    ("realistic_scenario", "- Nothing that could not happen this week"),
    ("vary_sentence_structure", "- No two requests start alike"),
    ("include_context_details", "- Some requests mention who, when or why"),
    ("multiple_phrasings", None),
    ("grammatically_correct", "- Proofread spelling and punctuation"),
    ("clear_expected_output", "- Name the deliverable"),
    ("testable_by_llm_judge", "- A grader must be able to say pass or fail"),
]
