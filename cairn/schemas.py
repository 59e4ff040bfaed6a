"""Record types of the data model as explicit Spark schemas, in DDL."""

LOGIC_SAMPLE = "`premises-NL` array<string>, `premises-FOL` array<string>, question string, answer string, example_id string, dataset_source string, split string, story_id string, explanation string, validation_error string, conclusion string, label string"
PHYSICS_ROW = "input string, output string, question string"
ROUTER_ROW = "input string, output string"
ROUTER_PAYLOAD = "domains array<string>, multi_state boolean"
ANSWER_ITEM = "pos int, raw string, unit string"
ITEM = "num double, txt string, unit string, raw string"
PHYSICS_TASK = "question string, correct struct<ans:string,unit:string>, metadata map<string,string>"
PHYSICS_RESULT = "question string, correct struct<ans:string,unit:string>, model_answer struct<ans:string,unit:string>, raw_response string, error string, tokens map<string,int>, elapsed_s double, domains array<string>"
PHYSICS_EVAL = "question string, correct struct<ans:string,unit:string>, model_answer struct<ans:string,unit:string>, raw_response string, error string, tokens map<string,int>, is_correct boolean, reason string"
VERIFICATION = "result string, proof string, unsat_core array<string>, model string, error string"
PIPELINE_ANSWER = "answer array<string>, confidence double, premises_fol array<string>, premises_nl array<string>, conclusion_fol string, verification struct<result:string,proof:string,unsat_core:array<string>,model:string,error:string>, reasoning string, cot array<string>"
PREDICT_REQUEST = "query_id string, type string, query string, premises array<string>, options array<string>"
PREDICT_RESPONSE = "query_id string, answer string, unit string, explanation string, premises_used array<int>, reasoning struct<type:string,steps:array<string>>"
CHAT = "messages array<struct<role:string,content:string>>"
GLOSSARY = "predicates array<string>, constants array<string>"
FAILURE = "question string, correct string, model_answer string, raw_response string, error string, reason string, input_tokens int, output_tokens int"
FOL_FAILED_CASE = "premises array<string>, expected array<string>, predicted array<string>, same boolean, syntax boolean, question string, qa_correct boolean"
PHYSICS_FAILED_CASE = "input string, expected string, predicted string, json boolean, syntax boolean, executed boolean, correct boolean"
ROUTER_FAILED_CASE = "input string, expected string, predicted string, same boolean, json boolean, domains boolean, multi_state boolean"
NOTATION = "canonical_latex string, meaning string, your_notation string"
TEXT_DOCUMENT = "name string, text string"
