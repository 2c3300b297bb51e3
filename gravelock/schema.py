"""Table shapes. A `specs` table has one row for each graph; everything else is derived from it, keyed by graph_id."""

EXPLOIT = "struct<id_exploit:int,granted:int,required:array<int>,cvss:double,text:string,cve_id:string>"
PROPOSITION = "struct<id_proposition:int,text:string,initial:boolean>"
SPECS = f"graph_id string, goal int, propositions array<{PROPOSITION}>, exploits array<{EXPLOIT}>"
#: Node-link files, as they stand on disk; ids_* only in state graphs.
NODE_LINK = (
    "directed boolean, multigraph boolean, graph struct<>, "
    "nodes array<struct<id:int,id_proposition:int,id_exploit:int,ids_propositions:array<int>>>, "
    "links array<struct<source:int,target:int,ids_exploits:array<int>>>, "
    "propositions map<string,struct<text:string,initial:boolean>>, "
    "exploits map<string,struct<text:string,granted_proposition:int,required_propositions:array<int>,cve_id:string,cvss:double>>, "
    "goal_proposition int, goal_nodes array<int>, type string"
)
EXPLOIT_LIST = "cve_id string, text string, cvss double"
SUMMARY = "state_path string, dependency_path string, n_nodes int, set int"
