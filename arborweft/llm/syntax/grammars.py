"""The grammars. Each covers the whole of its language's statement and expression forms as used in source files."""

from __future__ import annotations

# --- Go ---------------------------------------------------------------------------------------------------------------

# Expressions come twice: in control clauses ({c} = C) a composite literal must not begin with a bare type name.
_GO_EXPR = """
Expr{c} <- Unary{c} (BinOp Unary{c})*
Unary{c} <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-') Unary{c} / Primary{c}
Primary{c} <- Operand{c} Suffix*
Operand{c} <- NUM / STR / 'func' Signature Block / '(' (Expr / Type) ')' / LitType LitValue / TypeLit '(' Expr ','? ')' {named} / NAME
ExprList{c} <- Expr{c} (',' Expr{c})*
Simple{c} <- ExprList{c} (AssignOp ExprList{c} / ':=' ExprList{c} / '++' / '--' / '<-' Expr{c})?
"""
GO = (
    """
File <- 'package' NAME ';' (Import ';')* (TopDecl ';')* EOF
Import <- 'import' ('(' (ImportSpec ';')* ImportSpec? ')' / ImportSpec)
ImportSpec <- ('.' / NAME)? STR
TopDecl <- 'func' Params? NAME TypeParams? Signature Block? / Decl
Decl <- 'const' (ConstSpec / '(' (ConstSpec ';')* ConstSpec? ')') / 'var' (VarSpec / '(' (VarSpec ';')* VarSpec? ')') / 'type' (TypeSpec / '(' (TypeSpec ';')* TypeSpec? ')')
ConstSpec <- Names (Type? '=' ExprList)?
VarSpec <- Names ('=' ExprList / Type ('=' ExprList)?)
TypeSpec <- NAME TypeParams &TypeStart Type / NAME '='? Type
TypeStart <- NAME / '*' / '[' / 'map' / 'chan' / 'func' / 'struct' / 'interface' / '(' / '<-'
Names <- NAME (',' NAME)*
Signature <- Params (Params / Type)?
Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- NAME '...'? Type / '...'? Type
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- Names Constraint
Constraint <- '~'? Type ('|' '~'? Type)*
Type <- TypeLit / '(' Type ')' / TypeName
TypeLit <- '*' Type / '[' ']' Type / '[' '...' ']' Type / '[' Expr ']' Type / 'map' '[' Type ']' Type / 'chan' '<-'? Type / '<-' 'chan' Type / 'func' Signature / Struct / Interface
TypeName <- NAME ('.' NAME)? ('[' Type (',' Type)* ','? ']')?
Struct <- 'struct' '{' (Field ';')* Field? '}'
Field <- (Names Type / '*'? TypeName / '(' '*'? TypeName ')') STR?
Interface <- 'interface' '{' (Method ';')* Method? '}'
Method <- NAME Signature / Constraint
LitType <- Struct / '[' ']' Type / '[' '...' ']' Type / '[' Expr ']' Type / 'map' '[' Type ']' Type
LitValue <- '{' (Element (',' Element)* ','?)? '}'
Element <- (LitValue / Expr) (':' (LitValue / Expr))?
Suffix <- '.' NAME / '.' '(' ('type' / Type) ')' / '[' Index ']' / '(' Args? ')'
Index <- Expr? ':' Expr? (':' Expr)? / IndexItem (',' IndexItem)* ','?
IndexItem <- Expr &(',' / ']') / Type
Args <- Arg (',' Arg)* '...'? ','?
Arg <- Expr &(',' / ')' / '...') / Type
BinOp <- '||' / '&&' / '==' / '!=' / '<' / '<=' / '>' / '>=' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '<<' / '>>' / '&' / '&^'
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
Block <- '{' Stmts '}'
Stmts <- (Stmt? ';')* Stmt?
Stmt <- Decl / NAME ':' !'=' Stmt? / 'go' Expr / 'defer' Expr / 'return' ExprList? / 'break' NAME? / 'continue' NAME? / 'goto' NAME / 'fallthrough' / Block / If / Switch / Select / For / Simple
If <- 'if' (SimpleC? ';')? ExprC Block ('else' (If / Block))?
Switch <- 'switch' (SimpleC? ';')? TypeGuard? SwitchTag? '{' (Case ':' Stmts)* '}'
TypeGuard <- (NAME ':=')? PrimaryC &'{'
SwitchTag <- SimpleC
Case <- 'case' CaseItem (',' CaseItem)* / 'default'
CaseItem <- Expr &(',' / ':') / Type
Select <- 'select' '{' (('case' Simple / 'default') ':' Stmts)* '}'
For <- 'for' (Block / (ExprListC (':=' / '='))? 'range' ExprC Block / SimpleC? ';' ExprC? ';' SimpleC? Block / ExprC Block)
"""
    + _GO_EXPR.format(c="", named="/ TypeName LitValue")
    + _GO_EXPR.format(c="C", named="")
)

# --- Java -------------------------------------------------------------------------------------------------------------

JAVA = """
Unit <- (Annotations 'package' Name ';')? ('import' 'static'? Name ('.' '*')? ';' / ';')* Module? (TypeDecl / ';')* EOF
Module <- Annotations "open"? "module" Name '{' (NAME (NAME / 'static')* Name ((NAME / 'static') Name (',' Name)*)? ';')* '}'
Name <- NAME ('.' NAME)*
Annotations <- Annotation*
Annotation <- '@' !'interface' Name ('(' AnnArgs? ')')?
AnnArgs <- NAME '=' AnnValue (',' NAME '=' AnnValue)* / AnnValue
AnnValue <- Annotation / '{' (AnnValue (',' AnnValue)*)? ','? '}' / Cond
Modifiers <- (Annotation / 'public' / 'protected' / 'private' / 'static' / 'abstract' / 'final' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !(':' / '->') / "sealed" / "non" '-' "sealed")*
TypeDecl <- Modifiers TypeBody
TypeBody <- 'class' NAME TypeParams? ('extends' Type)? ('implements' Types)? ("permits" Types)? ClassBody / 'interface' NAME TypeParams? ('extends' Types)? ("permits" Types)? ClassBody / 'enum' NAME ('implements' Types)? EnumBody / "record" NAME TypeParams? '(' (Param (',' Param)*)? ')' ('implements' Types)? ClassBody / '@' 'interface' NAME ClassBody
Types <- Type (',' Type)*
TypeParams <- '<' TypeParam (',' TypeParam)* '>'
TypeParam <- Annotations NAME ('extends' Type ('&' Type)*)?
EnumBody <- '{' (EnumConst (',' EnumConst)*)? ','? (';' Member*)? '}'
EnumConst <- Annotations NAME Args? ClassBody?
ClassBody <- '{' Member* '}'
Member <- ';' / 'static'? Block / Modifiers (TypeBody / TypeParams? (NAME Params Throws? Block / NAME Block / Result NAME Params Dims Throws? ('default' AnnValue)? (Block / ';')) / Type Declarator (',' Declarator)* ';')
Result <- 'void' / Type
Throws <- 'throws' Types
Params <- '(' (Param (',' Param)*)? ')'
Param <- Modifiers Type Annotations '...'? (NAME '.')* (NAME / 'this') Dims
Dims <- (Annotations '[' ']')*
Declarator <- NAME Dims ('=' Init)?
Init <- '{' (Init (',' Init)*)? ','? '}' / Expr
Type <- Annotations (Primitive / ClassType) Dims
Primitive <- 'boolean' / 'byte' / 'short' / 'int' / 'long' / 'char' / 'float' / 'double'
ClassType <- NAME TypeArgs? ('.' Annotations NAME TypeArgs?)*
TypeArgs <- '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg <- Annotations '?' (('extends' / 'super') Type)? / Type
Block <- '{' BlockStmt* '}'
BlockStmt <- LocalClass / LocalVar ';' / Stmt
LocalClass <- Modifiers &('class' / 'interface' / 'enum' / "record" NAME ('(' / '<')) TypeBody
LocalVar <- Modifiers Type Declarator (',' Declarator)*
Stmt <- Block / ';' / 'if' Paren Stmt ('else' Stmt)? / 'for' '(' ForHead ')' Stmt / 'while' Paren Stmt / 'do' Stmt 'while' Paren ';' / Try / 'switch' Paren SwitchBody / 'synchronized' Paren Block / 'return' Expr? ';' / 'throw' Expr ';' / 'break' NAME? ';' / 'continue' NAME? ';' / "yield" !('=' / '.' / '(' / '[' / '++' / '--') Expr ';' / 'assert' Expr (':' Expr)? ';' / NAME ':' Stmt / ExprStmt ';'
ExprStmt <- Expr
Paren <- '(' Expr ')'
ForHead <- Modifiers Type NAME Dims ':' Expr / (LocalVar / Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)?
Try <- 'try' ('(' Resource (';' Resource)* ';'? ')')? Block ('catch' '(' Modifiers Type ('|' Type)* NAME ')' Block)* ('finally' Block)?
Resource <- Modifiers Type NAME '=' Expr / Expr
SwitchBody <- '{' (Arrow+ / (Label+ BlockStmt*)*) '}'
Label <- ('case' CaseItem (',' CaseItem)* Guard? / 'default') ':'
Arrow <- ('case' CaseItem (',' CaseItem)* Guard? / 'default') '->' (Block / 'throw' Expr ';' / Expr ';')
CaseItem <- 'default' / Pattern &(',' / ':' / '->' / "when") / Cond
Guard <- "when" Expr
Pattern <- Modifiers Type ('(' (Pattern (',' Pattern)*)? ')' NAME? / NAME)
Expr <- Lambda / Cond (AssignOp Expr)?
AssignOp <- '=' !'=' / '+=' / '-=' / '*=' / '/=' / '/' '=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>' '>'? ('=' / '>=') / '>' '>='
Lambda <- (NAME / '(' (LambdaParam (',' LambdaParam)*)? ')') '->' (Block / Expr)
LambdaParam <- Param / NAME
Cond <- Binary ('?' (Lambda / Expr) ':' (Lambda / Cond))?
Binary <- Unary (BinOp Unary / 'instanceof' (Pattern / 'final'? Type))*
BinOp <- '||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '<<' / '<' / '>' '=' / '>' '>' '>'? / '>' / '+' / '-' / '*' / '/' / '%'
Unary <- ('+' / '-' / '++' / '--' / '!' / '~') Unary / Cast / Postfix
Cast <- '(' Primitive Dims ')' Unary / '(' Type ('&' Type)* ')' (Lambda / &('(' / '!' / '~' / NAME / STR / NUM / 'this' / 'super' / 'new' / 'true' / 'false' / 'null' / 'switch' / Primitive) Unary)
Postfix <- Primary Selector* ('++' / '--')*
Primary <- NUM / STR / 'true' / 'false' / 'null' / 'this' Args? / 'super' (Args / &('.' / '::')) / 'new' Creator / 'switch' Paren SwitchBody / Type '::' TypeArgs? (NAME / 'new') / (Primitive / 'void') Dims '.' 'class' / NAME ('[' ']')+ '.' 'class' / '(' Expr ')' / NAME Args?
Creator <- Annotations (Primitive / NAME TypeArgs? ('.' Annotations NAME TypeArgs?)*) (Args ClassBody? / ('[' Expr ']')+ Dims / ('[' ']')+ Init)
Selector <- '.' (TypeArgs? NAME Args? / 'new' Creator / 'class' / 'this' / TypeArgs? 'super' (Args / &('.' / '::')) / 'super' Args?) / '[' Expr ']' / '::' TypeArgs? (NAME / 'new')
Args <- '(' (Expr (',' Expr)*)? ')'
"""

# --- JavaScript and TypeScript ----------------------------------------------------------------------------------------

_JS = """
Program <- Stmt* EOF
End <- ';' / &'}' / &EOF / @nl
Stmt <- Block / ';' / Var End / 'if' Paren Stmt ('else' Stmt)? / For / 'while' Paren Stmt / 'do' Stmt 'while' Paren ';'? / 'continue' (@join NAME)? End / 'break' (@join NAME)? End / 'return' (@join Expr)? End / 'with' Paren Stmt / 'switch' Paren '{' (('case' Expr / 'default') ':' Stmt*)* '}' / 'throw' @join Expr End / Try / 'debugger' End / Function / Class / Import / Export / TsStmt / NAME ':' Stmt / !("let" '[') Expr End
Block <- '{' Stmt* '}'
Paren <- '(' Expr ')'
Var <- ('var' / 'const' !'enum' / "let" &(NAME / '[' / '{') / "using" &NAME / "await" "using" &NAME) Declarator (',' Declarator)*
Declarator <- Binding '!'? TypeAnn? ('=' Assign)?
Binding <- NAME / '[' (','* BindItem (',' (BindItem / &(',' / ']')))*)? ','* ']' / '{' (BindProp (',' BindProp)*)? ','? '}'
BindItem <- '...'? Binding ('=' Assign)?
BindProp <- '...' NAME / Key ':' Binding ('=' Assign)? / NAME ('=' Assign)?
For <- 'for' "await"? '(' ForHead ')' Stmt
ForHead <- ('var' / 'const' / "let") Binding TypeAnn? ("of" Assign / 'in' Expr) / Lhs ("of" Assign / 'in' Expr) / (Var / Expr)? ';' Expr? ';' Expr?
Try <- 'try' Block ('catch' ('(' Binding TypeAnn? ')')? Block ('finally' Block)? / 'finally' Block)
Function <- "async"? 'function' '*'? NAME TypeParams? Params RetAnn? FuncBody
FuncBody <- Block
Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- Decorator* ParamMods '...'? (Binding / 'this') Optional? TypeAnn? ('=' Assign)?
Decorator <- '@' (NAME ('.' WORD)* Args? / Paren)
Class <- Decorator* Abstract? 'class' NAME? TypeParams? ('extends' Lhs TypeArgs?)? Implements? ClassBody
ClassBody <- '{' (';' / ClassMember)* '}'
ClassMember <- 'static' Block / "static" Block / Decorator* MemberMods (IndexSig End / ("get" / "set") &(Key Params) Key Params RetAnn? BodyEnd / ("async" @join)? '*'? Key Optional? TypeParams? Params RetAnn? BodyEnd / Key Optional? TypeAnn? ('=' Assign)? End)
BodyEnd <- Block / NoBody
MemberMods <- ("static" &MemberNext / ModHook)*
MemberNext <- WORD / STR / NUM / '[' / '*' / PRIV
Key <- WORD / STR / NUM / PRIV / '[' Assign ']'
Import <- 'import' !('(' / '.') (STR / TypeOnly? ImportClause "from" STR / ImportHook) ImportAttr? End
ImportClause <- NAME (',' (Named / '*' "as" NAME))? / Named / '*' "as" NAME
Named <- '{' (Spec (',' Spec)* ','?)? '}'
Spec <- TypeOnly? (WORD / STR) ("as" (WORD / STR))? / WORD ("as" WORD)?
ImportAttr <- ('with' / "assert") Object
Export <- Decorator* 'export' (ExportHook / '*' ("as" (WORD / STR))? "from" STR ImportAttr? End / TypeOnly? Named ("from" STR ImportAttr?)? End / 'default' (FunctionDefault / Class / TsStmt / Assign End) / Var End / Function / Class / TsStmt)
FunctionDefault <- "async"? 'function' '*'? NAME? TypeParams? Params RetAnn? FuncBody
Expr <- Assign (',' Assign)*
Assign <- Arrow / Yield / Cond (AssignOp Assign)?
Yield <- "yield" !('=' / '=>' / '.' / ')' / ',' / '+' / '(' ')' / '[' ']') ('*' Assign / @join Assign)? &(';' / ')' / ']' / '}' / ',' / ':' / EOF / AnyNl)
AnyNl <- @nl
AssignOp <- '=' / '+=' / '-=' / '*=' / '**=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>' '>'? '=' / '>>>=' / '>' '>' '>=' / '>' '>=' / '&&=' / '||=' / '??='
Arrow <- ("async" @join)? (NAME / TypeParams? Params RetAnn?) @join '=>' (Block / Assign)
Cond <- Binary ('?' Assign ':' Assign)?
Binary <- (PRIV 'in')? Unary (BinOp Unary / CastHook)*
BinOp <- '??' / '||' / '&&' / '|' / '^' / '&' / '===' / '!==' / '==' / '!=' / '<=' / '<<' / '<' / '>' '=' / '>' '>' '>'? / '>' / 'instanceof' / 'in' / '+' / '-' / '**' / '*' / '/' / '%'
Unary <- ('delete' / 'void' / 'typeof' / '+' / '-' / '~' / '!' / '++' / '--') Unary / "await" !('=' / '=>' / '.' / ')' / ',' / ';') Unary / AngleHook / Postfix
Postfix <- Lhs (@join ('++' / '--'))?
Lhs <- Primary Suffix*
Primary <- FunctionExpr / NAME / NUM / STR / REGEX / Template / 'this' / 'super' &('.' / '[' / '(') / 'null' / 'true' / 'false' / Array / Object / Class / '(' Expr ')' / 'new' New / 'import' ('(' Assign (',' Assign)? ','? ')' / '.' WORD)
FunctionExpr <- ("async" @join)? 'function' '*'? NAME? TypeParams? Params RetAnn? FuncBody
New <- '.' WORD / ('new' New / Primary) NewPart* TypeArgs? Args?
NewPart <- '.' (WORD / PRIV) / '[' Expr ']'
Suffix <- '.' (WORD / PRIV) / '?.' (WORD / PRIV / '[' Expr ']' / TypeArgs? Args / Template) / '[' Expr ']' / Args / Template / BangHook / TypeArgs &('(' / TPL / TPLHEAD) (Args / Template)
Args <- '(' (Arg (',' Arg)* ','?)? ')'
Arg <- '...'? Assign
Template <- TPL / TPLHEAD Expr (TPLMID Expr)* TPLEND
Array <- '[' (',' / ArrayItem (',' / &']'))* ']'
ArrayItem <- '...'? Assign
Object <- '{' (Prop (',' Prop)* ','?)? '}'
Prop <- '...' Assign / ("get" / "set") Key Params RetAnn? FuncBody / ("async" @join)? '*'? Key TypeParams? Params RetAnn? FuncBody / Key ':' Assign / NAME ('=' Assign)?
"""
JAVASCRIPT = (
    _JS
    + """
TypeAnn <- FAIL
RetAnn <- FAIL
TypeParams <- FAIL
TypeArgs <- FAIL
Optional <- FAIL
Abstract <- FAIL
Implements <- FAIL
IndexSig <- FAIL
NoBody <- FAIL
ModHook <- FAIL
ParamMods <- &EOF?
TypeOnly <- FAIL
ImportHook <- FAIL
ExportHook <- FAIL
CastHook <- FAIL
AngleHook <- FAIL
BangHook <- FAIL
TsStmt <- FAIL
"""
)
TYPESCRIPT = (
    _JS
    + """
TypeAnn <- ':' Type
RetAnn <- ':' ("asserts" (NAME / 'this') ("is" Type)? / (NAME / 'this') "is" Type / Type)
TypeParams <- '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- ('const' / 'in' / "out")* NAME ('extends' Type)? ('=' Type)?
TypeArgs <- '<' Type (',' Type)* '>'
Optional <- '?' / '!'
Abstract <- "abstract" / "declare" "abstract"?
Implements <- "implements" Type (',' Type)*
IndexSig <- '[' NAME ':' Type ']' TypeAnn
NoBody <- End
ModHook <- ("public" / "private" / "protected" / "readonly" / "abstract" / "override" / "declare" / "accessor") &MemberNext
ParamMods <- (("public" / "private" / "protected" / "readonly" / "override") &(NAME / '[' / '{'))*
TypeOnly <- "type" &(NAME / '{' / '*' / STR / WORD) !("from" STR)
ImportHook <- TypeOnly? NAME '=' (NAME '(' STR ')' / NAME ('.' WORD)*)
ExportHook <- '=' Expr End / "as" NAME NAME End / ImportAlias End
ImportAlias <- 'import' TypeOnly? NAME '=' (NAME '(' STR ')' / NAME ('.' WORD)*)
CastHook <- ("as" / "satisfies") @join ('const' / Type)
AngleHook <- '<' ('const' / Type) '>' Unary
BangHook <- @join '!' !('=' / '==')
TsStmt <- "interface" @join NAME TypeParams? ('extends' Type (',' Type)*)? ObjType / "type" @join NAME TypeParams? '=' Type End / 'const'? 'enum' NAME EnumBody / "declare" @join ("global" Block / Var End / Function_ / Class / TsStmt) / "abstract" @join Class / ("namespace" / "module") @join (STR / NAME ('.' NAME)*) (Block / End) / "global" Block / Function_ / ImportAlias End
Function_ <- "async"? 'function' '*'? NAME TypeParams? Params RetAnn? End
EnumBody <- '{' (EnumItem (',' EnumItem)* ','?)? '}'
EnumItem <- Key ('=' Assign)?
Type <- CondType
CondType <- UnionType (@join 'extends' UnionType '?' Type ':' Type)?
UnionType <- '|'? InterType ('|' InterType)*
InterType <- '&'? UnaryType ('&' UnaryType)*
UnaryType <- ("keyof" / "unique" / "readonly" / "infer") &TypeHead UnaryType ('extends' UnionType !'?')? / FuncType / PostType
TypeHead <- WORD / '(' / '[' / '{' / STR / NUM / TPL / TPLHEAD / '-'
FuncType <- ("abstract"? 'new')? TypeParams? Params '=>' ("asserts" NAME ("is" Type)? / (NAME / 'this') "is" Type / Type)
PostType <- PrimType (@join '[' Type? ']')*
PrimType <- '(' Type ')' / '[' (TupleItem (',' TupleItem)* ','?)? ']' / Mapped / ObjType / 'typeof' ('import' '(' STR ')' / NAME / 'this') ('.' WORD)* TypeArgs? / 'import' '(' Type ')' ('.' WORD)* TypeArgs? / STR / '-'? NUM / 'null' / 'true' / 'false' / 'void' / 'this' / TPL / TPLHEAD Type (TPLMID Type)* TPLEND / NAME ('.' WORD)* (@join TypeArgs)?
TupleItem <- '...'? (NAME '?'? ':')? Type '?'?
Mapped <- '{' (('+' / '-')? "readonly")? '[' NAME 'in' Type ("as" Type)? ']' (('+' / '-')? '?')? TypeAnn? ';'? '}'
ObjType <- '{' (TypeMember (';' / ',' / &'}' / @nl))* '}'
TypeMember <- ("readonly" &MemberNext / ("get" / "set") &(Key Params))* (IndexSig / 'new'? TypeParams? Params RetAnn? / Key '?'? TypeParams? Params RetAnn? / Key '?'? TypeAnn?)
"""
)

# --- Python -----------------------------------------------------------------------------------------------------------

PYTHON = """
File <- (NEWLINE / Stmt)* EOF
Stmt <- Compound / SimpleLine
SimpleLine <- Small (';' Small)* ';'? NEWLINE
Suite <- NEWLINE INDENT (NEWLINE / Stmt)+ DEDENT / SimpleLine
Compound <- 'if' NamedExpr ':' Suite ('elif' NamedExpr ':' Suite)* ('else' ':' Suite)? / 'while' NamedExpr ':' Suite ('else' ':' Suite)? / For / Try / With / Def / Class / Decorated / 'async' (Def / With / For) / Match
For <- 'for' Targets 'in' StarExprs ':' Suite ('else' ':' Suite)?
Try <- 'try' ':' Suite (('except' '*'? (Expr ('as' NAME / (',' Expr)+)?)? ':' Suite)+ ('else' ':' Suite)? ('finally' ':' Suite)? / 'finally' ':' Suite)
With <- 'with' ('(' WithItem (',' WithItem)* ','? ')' ':' / WithItem (',' WithItem)* ':') Suite
WithItem <- Expr ('as' StarTarget)?
Def <- 'def' NAME TypeParams? '(' Params? ')' ('->' StarExprs)? ':' Suite
Class <- 'class' NAME TypeParams? ('(' Args? ')')? ':' Suite
Decorated <- ('@' NamedExpr NEWLINE)+ ('async'? Def / Class)
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- ('*' / '**')? NAME (':' Expr)? ('=' StarExpr)?
Params <- Param (',' Param)* ','?
Param <- '/' / '**' NAME (':' Expr)? / '*' (NAME (':' StarExpr)?)? / NAME (':' Expr)? ('=' Expr)?
Match <- "match" StarNamed ':' NEWLINE INDENT (NEWLINE / "case" Patterns ('if' NamedExpr)? ':' Suite)+ DEDENT
StarNamed <- StarNamedItem (',' StarNamedItem)* ','?
StarNamedItem <- '*' BitOr / NamedExpr
Patterns <- Pattern (',' Pattern)* ','?
Pattern <- '*' NAME / OrPattern ('as' NAME)?
OrPattern <- ClosedPattern ('|' ClosedPattern)*
ClosedPattern <- '-'? NUM (('+' / '-') NUM)? / STR+ / 'None' / 'True' / 'False' / NAME ('.' NAME)* ('(' (PatArg (',' PatArg)* ','?)? ')')? / '(' Patterns? ')' / '[' Patterns? ']' / '{' (MapItem (',' MapItem)* ','?)? '}'
PatArg <- NAME '=' Pattern / Pattern
MapItem <- '**' NAME / (ClosedPattern) ':' Pattern
Small <- 'pass' / 'break' / 'continue' / 'return' StarExprs? / 'raise' (Expr ('from' Expr)?)? / 'global' NAME (',' NAME)* / 'nonlocal' NAME (',' NAME)* / 'del' Targets / 'assert' Expr (',' Expr)? / Import / TypeAlias / ExprStmt
TypeAlias <- "type" NAME TypeParams? '=' Expr
Import <- 'import' Dotted ('as' NAME)? (',' Dotted ('as' NAME)?)* / 'from' (('.' / '...')* Dotted / ('.' / '...')+) 'import' ('*' / '(' ImportAs (',' ImportAs)* ','? ')' / ImportAs (',' ImportAs)*)
ImportAs <- NAME ('as' NAME)?
Dotted <- NAME ('.' NAME)*
ExprStmt <- StarExprs (':' Expr ('=' (Yield / StarExprs))? / AugOp (Yield / StarExprs) / ('=' (Yield / StarExprs))+)? / Yield
AugOp <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
Targets <- StarTarget (',' StarTarget)* ','?
StarTarget <- '*' StarTarget / AwaitPrimary
StarExprs <- StarExpr (',' StarExpr)* ','?
StarExpr <- '*' BitOr / NamedExpr
NamedExpr <- NAME ':=' Expr / Expr
Yield <- 'yield' ('from' Expr / StarExprs)?
Expr <- Lambda / Or ('if' Or 'else' Expr)?
Lambda <- 'lambda' LambdaParams? ':' Expr
LambdaParams <- LambdaParam (',' LambdaParam)* ','?
LambdaParam <- '/' / '**' NAME / '*' NAME? / NAME ('=' Expr)?
Or <- And ('or' And)*
And <- Not ('and' Not)*
Not <- 'not' Not / Compare
Compare <- BitOr (('==' / '!=' / '<=' / '<' / '>=' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is') BitOr)*
BitOr <- BitXor ('|' BitXor)*
BitXor <- BitAnd ('^' BitAnd)*
BitAnd <- Shift ('&' Shift)*
Shift <- Sum (('<<' / '>>') Sum)*
Sum <- Term (('+' / '-') Term)*
Term <- Factor (('*' / '//' / '/' / '%' / '@') Factor)*
Factor <- ('+' / '-' / '~') Factor / Power
Power <- AwaitPrimary ('**' Factor)?
AwaitPrimary <- 'await'? Atom Trailer*
Trailer <- '.' NAME / '(' Args? ')' / '[' Slices ']'
Slices <- Slice (',' Slice)* ','?
Slice <- Expr? ':' Expr? (':' Expr?)? / '*' BitOr / NamedExpr
Args <- Arg (',' Arg)* ','?
Arg <- '**' Expr / '*' Expr / NAME '=' !'=' Expr / NamedExpr CompFor?
Atom <- NAME / NUM / STR+ / 'None' / 'True' / 'False' / '...' / '(' (Yield / StarNamedItem CompFor / StarNamed)? ')' / '[' (StarNamedItem CompFor / StarNamed)? ']' / '{' (DictItem (CompFor / (',' DictItem)* ','?) / StarNamedItem CompFor / StarNamed)? '}'
DictItem <- '**' BitOr / Expr ':' Expr
CompFor <- ('async'? 'for' Targets 'in' Or_ ('if' Or_)*)+
Or_ <- NAME ':=' Or / Lambda / Or
"""

# --- SQL --------------------------------------------------------------------------------------------------------------

# Common ground of PostgreSQL, MySQL, SQLite and T-SQL. Words are upper case here; RESERVED words are no identifiers.
SQL = """
File <- ';'* (Stmt (';'+ / "GO" / &EOF))* EOF
Stmt <- Query / Insert / Update / Delete / Create / Alter / Drop / Truncate / Transaction / Grant / Comment / Call / Set / Do / Explain / Copy / Other
Reserved <- "SELECT" / "FROM" / "WHERE" / "GROUP" / "HAVING" / "ORDER" / "BY" / "UNION" / "INTERSECT" / "EXCEPT" / "INSERT" / "INTO" / "UPDATE" / "DELETE" / "CREATE" / "TABLE" / "ALTER" / "DROP" / "AND" / "OR" / "NOT" / "NULL" / "CASE" / "WHEN" / "THEN" / "ELSE" / "END" / "AS" / "ON" / "USING" / "JOIN" / "INNER" / "LEFT" / "RIGHT" / "FULL" / "CROSS" / "NATURAL" / "LIMIT" / "OFFSET" / "FETCH" / "WINDOW" / "RETURNING" / "VALUES" / "SET" / "WITH" / "IN" / "IS" / "LIKE" / "ILIKE" / "BETWEEN" / "EXISTS" / "DISTINCT" / "PRIMARY" / "FOREIGN" / "REFERENCES" / "CONSTRAINT" / "CHECK" / "UNIQUE" / "DEFAULT" / "FOR" / "LATERAL" / "ALL" / "ANY" / "SOME"
Id <- QUOTED / !Reserved NAME
Label <- QUOTED / NAME
Name <- Id ('.' (Label / '*'))*
Names <- Id (',' Id)*
Query <- With? QueryTerm (("UNION" / "INTERSECT" / "EXCEPT" / "MINUS") ("ALL" / "DISTINCT")? QueryTerm)* Order? Tail*
With <- "WITH" "RECURSIVE"? Cte (',' Cte)*
Cte <- Id ('(' Names ')')? "AS" ("NOT"? "MATERIALIZED")? '(' (Query / Insert / Update / Delete) ')'
QueryTerm <- Select / "VALUES" Row (',' Row)* / '(' Query ')' / "TABLE" Name
Row <- '(' (DefaultExpr (',' DefaultExpr)*)? ')'
DefaultExpr <- "DEFAULT" / Expr
Select <- "SELECT" ("ALL" / "DISTINCT" ("ON" '(' Exprs ')')?)? ("TOP" (NUM / '(' Expr ')') "PERCENT"?)? Item (',' Item)* ("INTO" Into)? From? ("WHERE" Expr)? Group? ("HAVING" Expr)? ("QUALIFY" Expr)? Windows?
Into <- ("TEMP" / "TEMPORARY" / "UNLOGGED" / "STRICT" / "TABLE")? Name (',' Name)*
Item <- '*' / Expr ("AS"? Alias)?
Alias <- QUOTED / STR / !(Reserved / "LOOP" / "QUALIFY" / "GO") NAME
From <- "FROM" TableRef (',' TableRef)*
TableRef <- TablePrimary (Join)*
Join <- ("NATURAL" / "CROSS" / "INNER" / ("LEFT" / "RIGHT" / "FULL") "OUTER"? / "CROSS" / "ASOF" / "ANTI" / "SEMI")* ("JOIN" / "APPLY") TablePrimary ("ON" Expr / "USING" '(' Names ')')?
TablePrimary <- ("LATERAL" / "ONLY")? ('(' Query ')' / '(' TableRef ')' / Name '(' Exprs? ')' ("WITH" "ORDINALITY")? / Name '*'?) TableAlias? Sample? ("WITH" '(' Names ')')?
TableAlias <- "AS"? !("WHEN" / "LOOP" / "TABLESAMPLE" / "QUALIFY" / "ASOF" / "ANTI" / "SEMI" / "GO") Id ('(' AliasCol (',' AliasCol)* ')')?
AliasCol <- Id Type?
Sample <- "TABLESAMPLE" Id '(' Exprs ')'
Group <- "GROUP" "BY" ("ALL" / GroupItem (',' GroupItem)*)
GroupItem <- "GROUPING" "SETS" '(' GroupItem (',' GroupItem)* ')' / ("ROLLUP" / "CUBE") '(' Exprs ')' / '(' ')' / Expr
Windows <- "WINDOW" Id "AS" '(' Over ')' (',' Id "AS" '(' Over ')')*
Order <- "ORDER" "BY" ("ALL" / SortItem (',' SortItem)*)
SortItem <- Expr ("ASC" / "DESC" / "USING" ('<' / '>'))? ("NULLS" ("FIRST" / "LAST"))?
Tail <- "LIMIT" ("ALL" / Expr (',' Expr)?) / "OFFSET" Expr ("ROW" / "ROWS")? / "FETCH" ("FIRST" / "NEXT") Expr? ("ROW" / "ROWS") ("ONLY" / "WITH" "TIES") / "FOR" ("UPDATE" / "SHARE" / "NO" "KEY" "UPDATE" / "KEY" "SHARE") ("OF" Name (',' Name)*)? ("NOWAIT" / "SKIP" "LOCKED")?
Exprs <- Expr (',' Expr)*
Expr <- And ("OR" And)*
And <- Not ("AND" Not)*
Not <- "NOT" Not / Compare
Compare <- Sum (CompareTail)*
CompareTail <- ('=' / '<>' / '!=' / '<=' / '>=' / '<' / '>' / '<=>' / '~' / '~*' / '!~' / '!~*' / '~~' / '@>' / '<@' / '&&' / ':=' / '=>' / '?|' / '?&' / '?') (("ANY" / "ALL" / "SOME") '(' (Query / Expr) ')' / Sum) / "IS" "NOT"? ("NULL" / "TRUE" / "FALSE" / "UNKNOWN" / "DISTINCT" "FROM" Sum) / ("ISNULL" / "NOTNULL") / "NOT"? ("IN" (Row / '(' Query ')' / Name) / "BETWEEN" "SYMMETRIC"? Sum "AND" Sum / ("LIKE" / "ILIKE" / "RLIKE" / "REGEXP" / "GLOB" / "MATCH" / "SIMILAR" "TO") Sum ("ESCAPE" Sum)?)
Sum <- Term (('+' / '-' / '||' / '|' / '&' / '#' / '^' / '->>' / '->' / '#>>' / '#>') Term)*
Term <- Unary (('*' / '/' / '%' / "DIV" / "MOD") Unary)*
Unary <- ('+' / '-' / '~' / '!' / '@') Unary / "PRIOR" Unary / Postfix
Postfix <- Atom ('::' Type / '[' Expr? (':' Expr?)? ']' / "AT" "TIME" "ZONE" Postfix / "COLLATE" Name / '.' (Label / '*'))*
Atom <- NUM / STR+ / DOLLAR / "NULL" / "CASE" Expr? ("WHEN" Expr "THEN" Expr)+ ("ELSE" Expr)? "END" / "EXISTS" '(' Query ')' / ("CAST" / "TRY_CAST" / "SAFE_CAST") '(' Expr "AS" Type ')' / "EXTRACT" '(' Id "FROM" Expr ')' / ("SUBSTRING" / "TRIM" / "OVERLAY" / "POSITION") '(' (("LEADING" / "TRAILING" / "BOTH")? Expr? ("FROM" / "IN" / "PLACING" / ',') Exprs ("FOR" Expr)? / Exprs) ')' / "INTERVAL" Expr Id? / "ARRAY" ('[' Exprs? ']' / '(' Query ')') / "ROW" Row / ("DATE" / "TIME" / "TIMESTAMP" / "TIMESTAMPTZ") STR / '(' Query ')' / '(' Exprs? ')' / '{' Id Exprs '}' / Function / Name / '?' / '*'
Function <- (Name / ("LEFT" / "RIGHT" / "SET" / "VALUES" / "ANY" / "IN" / "IF" / "REPLACE")) '(' (("DISTINCT" / "ALL")? FuncArg (',' FuncArg)* Order? ("SEPARATOR" STR)? Tail*)? ')' ("WITHIN" "GROUP" '(' Order ')')? ("FILTER" '(' "WHERE" Expr ')')? (("IGNORE" / "RESPECT") "NULLS")? ("OVER" (Id / '(' Over ')'))?
FuncArg <- "VARIADIC"? (Query / Expr)
Over <- (!("PARTITION" / "ROWS" / "RANGE" / "GROUPS") Id)? ("PARTITION" "BY" Exprs)? Order? (("ROWS" / "RANGE" / "GROUPS") (Bound / "BETWEEN" Bound "AND" Bound) ("EXCLUDE" Id Id?)?)?
Bound <- "UNBOUNDED" ("PRECEDING" / "FOLLOWING") / "CURRENT" "ROW" / Sum ("PRECEDING" / "FOLLOWING")
Type <- TypeName ('(' TypeArg (',' TypeArg)* ')')? ("UNSIGNED" / "SIGNED" / "ZEROFILL" / "VARYING" ('(' NUM ')')? / ("WITH" / "WITHOUT") "LOCAL"? "TIME" "ZONE")* ("CHARACTER" "SET" Id)? ('[' NUM? ']')* ("ARRAY")? ('%' ("TYPE" / "ROWTYPE"))?
TypeArg <- NUM / STR / "MAX" / Id Type?
TypeName <- "DOUBLE" "PRECISION" / ("CHARACTER" / "NATIONAL")? "CHARACTER" "VARYING" / "SETOF" Name / "TABLE" '(' FieldDef (',' FieldDef)* ')' / "STRUCT" '<' FieldDef (',' FieldDef)* '>' / "ENUM" '(' STR (',' STR)* ')' / "SET" '(' STR (',' STR)* ')' / Name
FieldDef <- Id ':'? Type
Insert <- With? ("INSERT" ("OR" Id)? "IGNORE"? / "REPLACE") "INTO" "TABLE"? Name ("AS" Id)? ('(' Name (',' Name)* ')')? ("OVERRIDING" Id "VALUE")? Output? ("DEFAULT" "VALUES" / "SET" Assign (',' Assign)* / Query) Conflict? Returning?
Conflict <- "ON" "CONFLICT" ('(' SortItem (',' SortItem)* ')' ("WHERE" Expr)? / "ON" "CONSTRAINT" Id)? "DO" ("NOTHING" / "UPDATE" "SET" Assign (',' Assign)* ("WHERE" Expr)?) / "ON" "DUPLICATE" "KEY" "UPDATE" Assign (',' Assign)*
Assign <- (Name / '(' Names ')') ('=' / ':=' / '+=') DefaultExpr
Output <- "OUTPUT" Item (',' Item)* ("INTO" Name)?
Returning <- "RETURNING" Item (',' Item)* ("INTO" Name (',' Name)*)?
Update <- With? "UPDATE" "ONLY"? TableRef "SET" Assign (',' Assign)* Output? From? ("WHERE" Expr)? Order? Tail* Returning?
Delete <- With? "DELETE" Name? "FROM" "ONLY"? Name TableAlias? Output? ("USING" TableRef (',' TableRef)*)? Join* ("WHERE" Expr)? Order? Tail* Returning?
IfNot <- "IF" "NOT" "EXISTS"
IfEx <- "IF" "EXISTS"
Create <- "CREATE" ("OR" ("REPLACE" / "ALTER"))? (CreateTable / CreateView / CreateIndex / CreateFunction / CreateTrigger / CreateType / CreateSchema / CreateSequence / CreatePolicy / CreateExtension / CreateDomain / CreateOther)
CreateTable <- ("GLOBAL" / "LOCAL")? ("TEMP" / "TEMPORARY" / "UNLOGGED" / "EXTERNAL" / "TRANSIENT")? "TABLE" IfNot? Name ("AS" Query ("WITH" "NO"? "DATA")? / "LIKE" Name / "PARTITION" "OF" Name PartBound / ('(' (Element (',' Element)* ','?)? ')') TableOption* ("AS" Query)?)
PartBound <- ("FOR" "VALUES" ("FROM" Row "TO" Row / "IN" Row / "WITH" Row) / "DEFAULT") TableOption*
Element <- TableConstraint / "LIKE" Name (("INCLUDING" / "EXCLUDING") Id)* / Column
Column <- ColumnName Type? ColumnConstraint*
ColumnName <- QUOTED / !("CONSTRAINT" / "PRIMARY" / "UNIQUE" / "FOREIGN" / "CHECK" / "SELECT" / "FROM" / "CREATE" / "TABLE" / "WHERE") NAME
ColumnConstraint <- ("CONSTRAINT" Id)? ("NOT" "NULL" / "NULL" / "PRIMARY" "KEY" ("ASC" / "DESC")? ("AUTOINCREMENT" / "CLUSTERED" / "NONCLUSTERED")? / "UNIQUE" "KEY"? / "CHECK" '(' Expr ')' / "DEFAULT" DefaultValue / References / "COLLATE" Name / "COMMENT" STR / "AUTO_INCREMENT" / "AUTOINCREMENT" / "IDENTITY" ('(' NUM ',' NUM ')')? / "GENERATED" ("ALWAYS" / "BY" "DEFAULT") "AS" ("IDENTITY" ('(' SeqOption* ')')? / '(' Expr ')' ("STORED" / "VIRTUAL")?) / "AS" '(' Expr ')' "PERSISTED"? / "ON" "UPDATE" Function / "ON" "UPDATE" Id / "STORAGE" Id / "DEFERRABLE" / "NOT" "DEFERRABLE" / "INITIALLY" Id)
DefaultValue <- '(' Expr ')' / Postfix / ('+' / '-') NUM
References <- "REFERENCES" Name ('(' Names ')')? (("MATCH" Id) / "ON" ("DELETE" / "UPDATE") ("CASCADE" / "RESTRICT" / "NO" "ACTION" / "SET" ("NULL" / "DEFAULT")))*
TableConstraint <- ("CONSTRAINT" Id)? ("PRIMARY" "KEY" ("CLUSTERED" / "NONCLUSTERED")? KeyCols / "UNIQUE" ("KEY" / "INDEX")? Id? KeyCols / ("KEY" / "INDEX") Id? KeyCols / "FOREIGN" "KEY" Id? '(' Names ')' References / "CHECK" '(' Expr ')' / "EXCLUDE" ("USING" Id)? Balanced) ("DEFERRABLE" / "NOT" ("DEFERRABLE" / "VALID") / "INITIALLY" Id / "WHERE" '(' Expr ')' / "USING" Id)*
KeyCols <- '(' SortItem (',' SortItem)* ')'
TableOption <- "ENGINE" '='? Id / "DEFAULT"? ("CHARSET" / "CHARACTER" "SET") '='? Id / "COLLATE" '='? Id / "COMMENT" '='? STR / "AUTO_INCREMENT" '='? NUM / "PARTITION" "BY" Id Balanced / "CLUSTER" "BY" Balanced / "INHERITS" Balanced / "WITH" Balanced / "WITHOUT" ("ROWID" / "OIDS") / "TABLESPACE" Id / "ON" "COMMIT" Id Id? / "ON" Id / "STRICT" / "ROW_FORMAT" '='? Id / "STORED" "AS" Id / "LOCATION" STR / "OPTIONS" Balanced / "USING" Id / ','
CreateView <- ("TEMP" / "TEMPORARY")? ("MATERIALIZED" / "RECURSIVE" / "SECURE")? "VIEW" IfNot? Name ('(' Names ')')? ("WITH" Balanced)? "AS" Query ("WITH" ("CASCADED" / "LOCAL")? "CHECK" "OPTION" / "WITH" "NO"? "DATA")?
CreateIndex <- ("UNIQUE" / "CLUSTERED" / "NONCLUSTERED" / "FULLTEXT" / "SPATIAL")* "INDEX" "CONCURRENTLY"? IfNot? Name? "ON" "ONLY"? Name ("USING" Id)? '(' IndexCol (',' IndexCol)* ')' ("INCLUDE" '(' Names ')' / "WITH" Balanced / "TABLESPACE" Id / "NULLS" "NOT"? "DISTINCT" / "WHERE" Expr)*
IndexCol <- Expr ("COLLATE" Name)? (!("ASC" / "DESC" / "NULLS") Id)? ("ASC" / "DESC")? ("NULLS" ("FIRST" / "LAST"))?
CreateFunction <- ("FUNCTION" / "PROCEDURE" / "PROC" / "AGGREGATE") IfNot? Name (('(' (FuncParam (',' FuncParam)*)? ')') / FuncParam (',' FuncParam)*)? ("RETURNS" Id? "TABLE" Balanced / "RETURNS" ("NULL" "ON" "NULL" "INPUT" / Type) / "LANGUAGE" (Id / STR) / "IMMUTABLE" / "STABLE" / "VOLATILE" / "STRICT" / "LEAKPROOF" / "CALLED" "ON" "NULL" "INPUT" / "SECURITY" ("DEFINER" / "INVOKER") / "PARALLEL" Id / "COST" NUM / "ROWS" NUM / "SET" Id ("TO" / '=') (Id / STR) (',' (Id / STR))* / "DETERMINISTIC" / "NOT" "DETERMINISTIC" / "READS" "SQL" "DATA" / "MODIFIES" "SQL" "DATA" / "NO" "SQL" / "CONTAINS" "SQL" / "COMMENT" STR / "WITH" Id / "EXTERNAL" / "WINDOW" / "AS" (DOLLAR / STR) (',' STR)? / "AS"? Body / "RETURN" Expr / "AS" Query)+
FuncParam <- ("IN" "OUT" / "IN" / "OUT" / "INOUT" / "VARIADIC")? (Id "AS"? Type / Type) (("DEFAULT" / '=' / ':=') Expr)? ("OUTPUT" / "OUT" / "READONLY")?
CreateTrigger <- ("CONSTRAINT" / "EVENT")? "TRIGGER" IfNot? Name ("BEFORE" / "AFTER" / "INSTEAD" "OF" / "ON") (Event (("OR" / ',') Event)*)? ("ON" Name)? ("REFERENCING" (("NEW" / "OLD") "TABLE" "AS"? Id)+ / "FOR" "EACH"? ("ROW" / "STATEMENT") / "WHEN" '(' Expr ')' / "WHEN" Expr / "DEFERRABLE" / "INITIALLY" Id / "NOT" "DEFERRABLE" / "FROM" Name / Event (("OR" / ',') Event)*)* (("EXECUTE" ("FUNCTION" / "PROCEDURE") Name '(' Exprs? ')') / "AS"? Body / Stmt)
Event <- "INSERT" / "UPDATE" ("OF" Names)? / "DELETE" / "TRUNCATE" / Id
Body <- "BEGIN" "ATOMIC"? (BodyStmt ';')* BodyStmt? "END" Id?
BodyStmt <- PlStmt / Stmt
CreateType <- "TYPE" IfNot? Name ("AS" ("ENUM" '(' (STR (',' STR)*)? ')' / "RANGE" Balanced / '(' (FieldDef (',' FieldDef)*)? ')' / Type) / "FROM" Type ("NOT" "NULL")? / Balanced)?
CreateSchema <- "SCHEMA" IfNot? Name? ("AUTHORIZATION" Id)?
CreateSequence <- ("TEMP" / "TEMPORARY")? "SEQUENCE" IfNot? Name SeqOption*
SeqOption <- "AS" Type / "INCREMENT" "BY"? '='? '-'? NUM / "START" "WITH"? '='? '-'? NUM / "MINVALUE" '-'? NUM / "MAXVALUE" '-'? NUM / "NO" ("MINVALUE" / "MAXVALUE" / "CYCLE") / "CACHE" NUM / "CYCLE" / "OWNED" "BY" Name
CreatePolicy <- "POLICY" Id "ON" Name ("AS" Id / "FOR" ("ALL" / "SELECT" / "INSERT" / "UPDATE" / "DELETE") / "TO" Names / "USING" '(' Expr ')' / "WITH" "CHECK" '(' Expr ')')*
CreateExtension <- "EXTENSION" IfNot? Id ("WITH" / "SCHEMA" Id / "VERSION" (STR / Id) / "CASCADE")*
CreateDomain <- "DOMAIN" Name "AS"? Type ColumnConstraint*
CreateOther <- ("DATABASE" / "ROLE" / "USER" / "STAGE" / "STREAM" / "TASK" / "FILE" "FORMAT" / "SYNONYM" / "PUBLICATION" / "SUBSCRIPTION" / "SERVER" / "FOREIGN" / "COLLATION" / "CAST" / "OPERATOR" / "RULE" / "STATISTICS" / "WAREHOUSE" / "MACRO" / "LOGIN" / "VIRTUAL") Loose+
Loose <- Balanced / !(';' / ')' / EOF / ERR / "CREATE") Any
Balanced <- '(' (Balanced / !('(' / ')' / ';' / EOF / ERR) Any)* ')'
Any <- NAME / QUOTED / STR / NUM / DOLLAR / ',' / '.' / '=' / '*' / '+' / '-' / '/' / '<' / '>' / '<=' / '>=' / '<>' / '!=' / '::' / '||' / ':' / '[' / ']' / '{' / '}' / '%' / '=>' / ':=' / '~' / '@' / '&' / '|' / '!'
Alter <- "ALTER" ("TABLE" IfEx? "ONLY"? Name AlterAction (',' AlterAction)* / ("VIEW" / "MATERIALIZED" "VIEW" / "INDEX" / "SEQUENCE" / "FUNCTION" / "PROCEDURE" / "TYPE" / "SCHEMA" / "DATABASE" / "ROLE" / "USER" / "DOMAIN" / "POLICY" / "TRIGGER" / "EXTENSION" / "DEFAULT" "PRIVILEGES" / "SYSTEM" / "SESSION" / "WAREHOUSE" / "TASK" / "STREAM") Loose+)
AlterAction <- "ADD" "COLUMN"? IfNot? Column / "ADD" TableConstraint / "ADD" '(' Element (',' Element)* ')' / "DROP" ("COLUMN" / "CONSTRAINT" / "INDEX" / "PRIMARY" "KEY" / "FOREIGN" "KEY")? IfEx? Id? ("CASCADE" / "RESTRICT")? / "RENAME" ("TO" Name / "COLUMN"? Id "TO" Id / "CONSTRAINT" Id "TO" Id) / ("ALTER" / "MODIFY" / "CHANGE") "COLUMN"? Id ("SET" ("DATA" "TYPE" Type / "DEFAULT" Expr / "NOT" "NULL" / Loose+) / "DROP" ("DEFAULT" / "NOT" "NULL" / "IDENTITY" IfEx?) / "TYPE" Type ("USING" Expr)? / Id? Type ColumnConstraint*) ("USING" Expr)? / "OWNER" "TO" Id / ("ENABLE" / "DISABLE" / "FORCE") Loose+ / "SET" Loose+ / ("ATTACH" / "DETACH") "PARTITION" Name PartBound? / "VALIDATE" "CONSTRAINT" Id / "INHERIT" Name / "CLUSTER" Loose+ / TableOption
Drop <- "DROP" ("TABLE" / "MATERIALIZED"? "VIEW" / "INDEX" "CONCURRENTLY"? / "FUNCTION" / "PROCEDURE" / "PROC" / "TRIGGER" / "SEQUENCE" / "TYPE" / "SCHEMA" / "DATABASE" / "EXTENSION" / "POLICY" / "DOMAIN" / "ROLE" / "USER" / "RULE" / "STAGE" / "STREAM" / "TASK" / "COLUMN" / "AGGREGATE" / "SYNONYM") IfEx? Name Balanced? (',' Name Balanced?)* ("ON" Name)? ("CASCADE" / "RESTRICT" / "PURGE")?
Truncate <- "TRUNCATE" "TABLE"? "ONLY"? Name (',' Name)* (("RESTART" / "CONTINUE") "IDENTITY")? ("CASCADE" / "RESTRICT")?
Transaction <- ("BEGIN" / "START") ("TRANSACTION" / "WORK" / "TRAN")? ("ISOLATION" "LEVEL" Id Id? / "READ" ("ONLY" / "WRITE") / ',')* &(';' / EOF) / ("COMMIT" / "END" / "ROLLBACK" / "ABORT") ("TRANSACTION" / "WORK" / "TRAN")? ("TO" "SAVEPOINT"? Id)? &(';' / EOF) / ("SAVEPOINT" / "RELEASE" "SAVEPOINT"?) Id
Grant <- ("GRANT" / "REVOKE") ("GRANT" "OPTION" "FOR")? GrantItem (',' GrantItem)* ("ON" (("ALL" Id "IN" "SCHEMA") / "TABLE" / "SEQUENCE" / "FUNCTION" / "SCHEMA" / "DATABASE" / "PROCEDURE" / "TYPE" / "WAREHOUSE" / "STAGE")? (Name / '*') ('.' '*')? Balanced? (',' Name Balanced?)*)? ("TO" / "FROM") ("ROLE" / "USER" / "GROUP")? Id (',' Id)* ("WITH" Id "OPTION")? ("CASCADE" / "RESTRICT")?
GrantItem <- ("ALL" "PRIVILEGES"? / "SELECT" / "INSERT" / "UPDATE" / "DELETE" / "REFERENCES" / "CREATE" / "ALTER" / "DROP" / Id) Id? ('(' Names ')')?
Comment <- "COMMENT" "ON" ("TABLE" / "COLUMN" / "VIEW" / "FUNCTION" / "INDEX" / "SCHEMA" / "TYPE" / "CONSTRAINT" / "TRIGGER" / "SEQUENCE" / "DATABASE" / "EXTENSION" / "DOMAIN" / "POLICY" / "PROCEDURE" / "MATERIALIZED" "VIEW") Name Balanced? ("ON" Name)? "IS" (STR / "NULL")
Call <- ("CALL" / "EXEC" / "EXECUTE") (Name '(' Exprs? ')' / "IMMEDIATE"? (STR / Name) (Exprs)? / Balanced) ("INTO" Names)? ("USING" Exprs)?
Set <- "SET" ("SESSION" / "LOCAL" / "GLOBAL")? ("TRANSACTION" Loose+ / Name ("TO" / '=' / ':=') ("DEFAULT" / Exprs) / "TIME" "ZONE" (STR / Id) / Name ("ON" / "OFF") / "CONSTRAINTS" Loose+ / "ROLE" Id)
Do <- "DO" (("LANGUAGE" Id) DOLLAR / DOLLAR ("LANGUAGE" Id)?)
Explain <- ("EXPLAIN" / "DESCRIBE") ("ANALYZE" / "VERBOSE" / Balanced)* Stmt
Copy <- "COPY" ("INTO" (Name / STR / '@' Name) Loose+ / Name ('(' Names ')')? ("FROM" / "TO") (STR / "STDIN" / "STDOUT" / "PROGRAM" STR) Loose* / Balanced "TO" (STR / "STDOUT") Loose*)
Other <- ("PRAGMA" / "USE" / "VACUUM" / "ANALYZE" / "REINDEX" / "REFRESH" / "LOCK" / "SHOW" / "NOTIFY" / "LISTEN" / "UNLISTEN" / "CLUSTER" / "DECLARE" / "FETCH" / "CLOSE" / "PREPARE" / "DEALLOCATE" / "DISCARD" / "RESET" / "LOAD" / "ATTACH" / "DETACH" / "PRINT" / "RAISERROR" / "MERGE" / "UNLOAD" / "PUT" / "REASSIGN" / "SECURITY" / "IMPORT" "FOREIGN") Loose*
Routine <- ("<" "<" Id ">" ">")? ("DECLARE" (PlDeclare ';')*)? "BEGIN" PlStmts ("EXCEPTION" ("WHEN" Expr "THEN" PlStmts)+)? "END" Id? ';'? EOF / (Stmt (';'+ / &EOF))* EOF
PlDeclare <- Id ("ALIAS" "FOR" (Id / NUM) / "CONSTANT"? Type ("COLLATE" Name)? ("NOT" "NULL")? (("DEFAULT" / ':=' / '=') Expr)? / "NO"? "SCROLL"? "CURSOR" Balanced? ("FOR" / "IS") Query)
PlStmts <- (PlStmt ';')*
PlStmt <- "IF" Expr "THEN" PlStmts (("ELSIF" / "ELSEIF") Expr "THEN" PlStmts)* ("ELSE" PlStmts)? "END" "IF" / "CASE" Expr? ("WHEN" Exprs "THEN" PlStmts)+ ("ELSE" PlStmts)? "END" "CASE" / ('<' '<' Id '>' '>')? ("LOOP" / "WHILE" Expr ("LOOP" / "DO") / "FOR" Names "IN" "REVERSE"? (Query / "EXECUTE" Expr ("USING" Exprs)? / Expr '.' '.' Expr ("BY" Expr)? / Expr) "LOOP" / "FOREACH" Id ("SLICE" NUM)? "IN" "ARRAY" Expr "LOOP") PlStmts "END" ("LOOP" / "WHILE") Id? / ("EXIT" / "CONTINUE") (!"WHEN" Id)? ("WHEN" Expr)? / "RETURN" ("QUERY" ("EXECUTE" Expr ("USING" Exprs)? / Query) / "NEXT" Expr / Query / Expr)? / "RAISE" (("DEBUG" / "LOG" / "INFO" / "NOTICE" / "WARNING" / "EXCEPTION")? (STR / Id) (',' Exprs)? ("USING" Id '=' Expr (',' Id '=' Expr)*)?)? / "PERFORM" (Expr (',' Expr)* From? ("WHERE" Expr)? Order? Tail*) / "EXECUTE" Expr ("INTO" "STRICT"? Name (',' Name)*)? ("USING" Exprs)? / "GET" "STACKED"? "DIAGNOSTICS" Assign (',' Assign)* / "ASSERT" Exprs / "NULL" / "OPEN" Name ("FOR" (Query / "EXECUTE" Expr) / Balanced)? / "FETCH" Loose+ / "CLOSE" Id / "DECLARE" PlDeclare (';' PlDeclare)* / ("DECLARE" (PlDeclare ';')*)? "BEGIN" PlStmts ("EXCEPTION" ("WHEN" Expr "THEN" PlStmts)+)? "END" Id? / "SET" Assign (',' Assign)* / Name ('[' Expr ']')* (':=' / '=') (Query / Expr) / Query / Insert / Update / Delete / Create / Alter / Drop / Truncate / Call / ("COMMIT" / "ROLLBACK") / "MERGE" Loose+
"""
