"""Fixed values.

Everything in this module must equal the values of the pipeline being
reproduced for results to match: word lists, phrases, prompt templates,
constant prompts, thresholds and the target score profile.  They are
written out plainly, in their natural order.  Templates use Python
``str.format`` syntax (``{name}`` is a slot, ``{{``/``}}`` are literal
braces) and are rendered column-wise by ``functions.templates``.
"""

# --- fixed values: prompt rejection (case-insensitive, substring) ----------
# Rows whose prompt contains every word of one group are rejected.
REJECT_ALL_WORD_GROUPS = (
    ("Translate", "from", "to"),
    ("code", "language"),
)
# Rows whose prompt contains any of these words are rejected (literal match).
REJECT_ANY_WORDS = (
    "painting", "logo", "programming", "json", "html", "markdown",
    "python", "java", "audio", "visual", "storyboard",
)
# Rows whose rewritten text contains any of these phrases are rejected.
BOILERPLATE_PHRASES = (
    "i am not able",
    "i'm not able",
    "text does not",
    "text doesn't",
    "i am unable",
    "i'm unable",
    "i will not provide",
    "i won't provide",
    "inappropriate",
    "the rewritten text",
    "the transformed text",
    "text rewritten",
    "text transformed",
    "here is the text",
    "text you provided",
    "text provided",
    "does not describe",
    "certainly",
)
# Markers that flag a first line of a rewritten text as a preamble.
PREAMBLE_MARKERS_HASH = "##"
PREAMBLE_MARKERS_STAR = "**"
PREAMBLE_WORDS = ("sure", "here's")

# --- fixed values: thresholds and sizes -----------------------------------
NEAR_IDENTICAL_MAX_RATIO = 95.0      # keep rows with ratio strictly below
MIN_ROWS_PER_ORIGINAL = 5            # keep originals with at least this many rows
MAX_TRAINING_TOKENS = 2048           # keep training items strictly below
SELECTION_TOLERANCE = 0.005          # TH of the greedy profile match
SELECTION_SIZE = 1500                # desired number of selected prompts
PROMPTS_PER_CLUSTER = 30             # sample size per cluster before selection
PROMPTS_TO_GENERATE = 10000
PROMPTS_PER_REQUEST = 10
VARIATIONS_PER_PROMPT = 6
DEFAULT_SPLIT = "train"
RESPONSE_MARKER = "[/INST]"

# --- fixed values: predictions ----------------------------------------------
DEFAULT_PREDICTED_PROMPT = "Make this text better"
BASELINE_MEAN_PROMPT = "improve phrasing text lucrarea tone lucrarea rewrite this creatively formalize discours involving lucrarea anyone emulate lucrarea description send casual perspective information alter it lucrarea ss plotline speaker recommend doing if elegy tone lucrarea more com n paraphrase ss forward this st text redesign poem above etc possible llm clear lucrarea"
MEAN_PROMPT = "conveying rephraselucrarea textimprovelucrarealucrarea formal paragraph help please creativelywstlucrarea tonealterations ence text comportthislucrarea messageresemblepoeticallylucrarea casuallyoper talkingpresentingstoryinvolvesmemo essrecommendtransformingthisdetailsresponsivephrasethr reframe it"
MEAN_PROMPT_BASE = "conveying rephraselucrarea  textimprovelucrarealucrarea {} formal paragraph help please creativelywstlucrarea tonealterations ence text comportthislucrarea messageresemblepoeticallylucrarea casuallyoper talkingpresentingstoryinvolvesmemo essrecommendtransformingthisdetailsresponsivephrasethr reframe it"

# --- fixed values: generation ----------------------------------------------
VARIATION_INSTRUCTIONS = (
    "making the prompt much more detailed, add as much details to the prompt as you can think",
    "adding new elements to the instruction, add one two new aspects to it",
    "adding a focus on a specific aspect of the instruction, this aspect can also be something new",
    "making the prompt more concise",
    "making the writing style of the prompt itself more informal",
    "making the writing style of the prompt itself more formal",
)
TEXT_MODELS = ("gemini", "gpt-3.5")

# --- fixed values: target profile for prompt selection (id, prompt, score) --
REFERENCE_PROFILE = (
    (1, "Please improve the following text using the writing style of, maintaining the original meaning but altering the tone, diction, and stylistic elements to match the new style.Enhance the clarity, elegance, and impact of the following text by adopting the writing style of , ensuring the core message remains intact while transforming the tone, word choice, and stylistic features to align with the specified style.", 0.61),
    (2, "Improve the text to this.", 0.6),
    (3, "Improve the text.", 0.59),
    (4, "Improve that text.", 0.58),
    (5, "Rewrite the text into a rhyming, sea-shanty style with a playful tone while maintaining the original information.", 0.57),
    (6, "original text elegance clarity improve style word tone meaning", 0.55),
    (7, "rephrase new version convey tone", 0.54),
    (8, "rephrase increase writing", 0.53),
    (9, "Transform the text into a humorous shanty and include a catchy chorus.", 0.5),
    (10, "Kindly refine the text below to mirror the writing style of , preserving its original intent yet modifying its tone, vocabulary, and stylistic details to resemble the new style. Boost the text's clarity, sophistication, and effectiveness by mimicking the writing style of , keeping the essential meaning unchanged but altering the tone, terminology, and style in accordance with the desired style.", 0.58),
    (11, "Please enhance the text provided, emulating the writing style of , while keeping the original intent but changing the tone, vocabulary, and style elements to align with the desired style.", 0.59),
    (12, "Kindly refine the subsequent text by adopting the writing style of , preserving its inherent meaning while modifying the tone, language, and stylistic nuances to reflect the new style.", 0.56),
    (13, "Make this text more negative.", 0.45),
    (14, "z", 0.40),
    (15, "The composition stands as a sequence of words arranged for potential contemplation, devoid of explicit intent or discernible purpose. It exists within a framework of neutrality, offering neither direction nor conclusion, inviting observation without expectation. The arrangement facilitates a space for presence, unattached to specific outcomes or interpretations.", 0.44),
    (16, "Improve rephrase text manner this written to has character in style.", 0.64),
)
TARGET_SCORES = tuple(score for _, _, score in REFERENCE_PROFILE)

# --- fixed values: prompt templates (str.format syntax) --------------------
CHAT_TEMPLATE = "<bos><start_of_turn>user\n{prompt}\n\n{text}<end_of_turn>\n<start_of_turn>model\n"

PROMPT_CREATION_TEMPLATE = (
    '\n'
    '        You are a text transformation prompt creator. Your job is to generate a random prompt that can be used to ask an LLM to transform, edit or rewrite a piece of text. Your prompts should never ask for translations between languages, nor involve generating other type of media (like song melodies, paintings, logos, audios, etc.) and not involve special type of text such as programming language, code, or anything similar. Again, the input and outputs should also be some kind of TEXT and TEXT ONLY. You should also not ask to generate text from scratch, every prompt should be directed at transforming a given input. You shall return both the actual prompt you propose but also the extra information in a JSON format as specified below:\n'
    '        \n'
    '        OUTPUT FORMAT\n'
    '        {{\n'
    '            "prompt": "The actual proposed prompt",\n'
    '            "input_characteristics": {{\n'
    '                "type": "What type of input should this prompt be used for, e.g.: email, poem, song, scientific article, etc.",\n'
    '                "style": "The style of the writing: e.g.: formal, informal, conversational, sci fi, fantasy, inspired by a specific artistic, etc.",\n'
    '                "domain": "What should the subject matter of the input be,",\n'
    '                "sentiment": "Overall sentintime of the input text",\n'
    '                "complexity": "Assess the complexity level.",\n'
    '                "length": "How long the text should be in generic terms (long, concise, short, abstract, etc.)",\n'
    '                "specific_characteristics": "Specific characteristics of the input, for example, if include grammar mistakes, or mentions to a political figure, or any specific king of content, etc.".\n'
    '            }},\n'
    '            "transformation_characteristics": {{\n'
    '                "type_of_transformation": "Define the transformation, e.g., summarization, paraphrasing, rewriting in a different style, rewriting in a different format, changing the target audience, correcting spelling and grammar, etc.",\n'
    '            }},\n'
    '            "output_characteristics": {{...this should have the same format as input_characteristics but for the expected output}}\n'
    '        }}\n'
    '                \n'
    '        Generate {n} examples for me, make the actual prompt short and concise using a maximum of 20 words. Be creative, include different types of transformations and styles dont focus only on the examples given here. Return a JSON with the format {{"examples": [your list of examples here]}} and nothing more.\n'
    '        '
)

TEXT_FROM_DESCRIPTION_TEMPLATE = (
    '\n'
    '        I wil give you a JSON input that describes charactertistics of a text. Your job is to generate a text that fits the description.\n'
    '        Use a maximum of 400 words in your response. Return only the text and nothing else.\n'
    '\n'
    '        JSON input:\n'
    '\n'
    '        {json_input}\n'
    '        '
)

VARIATION_REQUEST_TEMPLATE = (
    '\n'
    '        I will provide you with a text that represents a prompt that was used to transform a text.\n'
    '        Your job is to return a variation of the same prompt by {variation}.\n'
    '\n'
    "        Keep the intent input and output types the same. If the input and output is not described in the original prompt don't make assumptions when proposing a variation, keep everything generic in this case.\n"
    '\n'
    '        Return only the new prompt using the following JSON structure:\n'
    '        {{"prompt": "The variation of the original prompt"}}\n'
    '\n'
    '        Return a valid JSON and nothing else. The output will be parsed so if its not a valid JSON it will faile, so please always provide a valid JSON and nothing more.\n'
    '\n'
    '        ----------------\n'
    '        Input: {original_prompt}\n'
    '        '
)

INFERENCE_INSTRUCTION_TEMPLATE = (
    '\n'
    '        I will give you a JSON with following structure:\n'
    '        {{\n'
    "            'original_text': 'An original piece of text.'\n"
    "            'rewritten_text': 'A version of original_text that was rewritten by an LLM according to a specific prompt.'\n"
    '        }}\n'
    '\n'
    '        Given the task of understanding how text is rewritten by analyzing the original_text and rewritten_text, your goal is to deduce the specific instructions or prompt that was most likely used to generate the rewritten text from the original text. Consider the changes made in terms of style, tone, structure, and content. Assess whether the rewrite focuses on summarization, paraphrasing, stylistic alteration (e.g., formal to informal), or any specific content changes (e.g., making the text more concise, expanding on ideas, or altering the perspective). Follow this steps:\n'
    '\n'
    '        1. Read the original_text: Start by thoroughly understanding the content, style, tone, and purpose of the original text. Note any key themes, technical terms, and the overall message.\n'
    '        2. Analyze the rewritten_text: Examine how the rewritten text compares to the original. Identify what has been changed, added, or omitted. Pay close attention to changes in style (formal, informal), tone (serious, humorous), structure (paragraph order, sentence structure), and any shifts in perspective or emphasis.\n'
    '        3. Infer the Prompt: Based on your analysis, infer the most likely prompt that guided the rewriting process. Your inference should account for the observed changes in style, tone, structure, and content. Specify the type of task (e.g., summarize, paraphrase, make more accessible to a general audience), any specific directions evident from the changes, and any specific stylistic choice.\n'
    '        4. Derive the main subject of the prompt: Identify the main subject of the prompt as a set of keywords.\n'
    '\n'
    '        Based on your analysis return the prompt and the set of keywords that make the main subject of the prompt. \n'
    '        Make the prompt as if you were given the instruction your self like:\n'
    '\n'
    '        "Rewrite this text..."\n'
    '        "Transform this ... into ... based on the style of ..."\n'
    '        \n'
    '        Make the prompt short and direct using a maximum of 20 words.\n'
    '\n'
    '        Return your answer using the following JSON structure:\n'
    '        {{\n'
    '            "prompt": "Your best guess for the prompt used",\n'
    '            "keywords": "The set of keywords as a single string separated by empty space that identify the main subject of the guessed prompt"\n'
    '        }}\n'
    '    \n'
    '            \n'
    '        Return a valid JSON as output and nothing more.\n'
    '        \n'
    '        -----------------------\n'
    '        Input:  {json_input}\n'
    '    '
)

TRAINING_TEMPLATE = (
    '<s> [INST]\n'
    '        I will give you a JSON with following structure:\n'
    '        {{\n'
    "            'original_text': 'An original piece of text.'\n"
    "            'rewritten_text': 'A version of original_text that was rewritten by an LLM according to a specific prompt.'\n"
    '        }}\n'
    '\n'
    '        Your job is to return the prompt that was used to transform the original_text into the rewritten_text.\n'
    '        \n'
    '        Make the prompt short and direct using a maximum of 20 words.\n'
    '\n'
    '        Return your answer using the following JSON structure:\n'
    '        {{"prompt": "Your best guess for the prompt used"}}\n'
    '    \n'
    '        Return a valid JSON as output and nothing more.\n'
    '        \n'
    '        -----------------------\n'
    '        Input: {input} [/INST] {output} </s>\n'
    '        '
)

